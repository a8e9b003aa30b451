"""Documents of a task are scored beside each other, however few words are looked up at a time."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from scoregate.llm import language_model as lm


def test_a_task_scores_its_documents_in_one_set_of_windows(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 30, n)) for n in (900, *rng.integers(0, 40, 60))]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(61)), pa.array(range(100, 161)), pa.array([k % 7 == 2 for k in range(61)]), pa.array(texts)], names=["row", "doc_id", "held_out", "text"]
    )
    tokens, counts = np.unique(np.concatenate(list(lm.token_lists(batch.column(3)))), return_counts=True)
    vocabulary = lm.Vocabulary(tokens, counts, int(counts.sum()), len(tokens))
    net = lm.Network(vocabulary)
    weights = (net.flat() + rng.normal(0, 0.2, net.flat().size)).astype(np.float32)
    whole, calls = lm.windows, []
    monkeypatch.setattr(lm, "windows", lambda docs, *rest: calls.append(len(docs)) or whole(docs, *rest))

    def run(chunk, scored):
        calls.clear()
        monkeypatch.setattr(lm, "CHUNK", chunk)
        monkeypatch.setattr(lm, "SCORED", scored, raising=False)
        out = [r for b in lm._score(SimpleNamespace(value=(vocabulary, weights)))(iter([batch])) for r in b.to_pylist() if r["kind"] == 0]
        return list(calls), {r["row"]: r for r in out}

    calls_of, want = run(10**6, 10**6)
    assert calls_of == [61] and len(want) == 61
    calls_of, got = run(100, 10**6)
    assert calls_of == [61], calls_of  # before: once for each chunk, the long document's lane alone in its own
    parts, piecewise = run(100, 300)
    assert len(parts) > 1 and sum(parts) == 61
    for found in (got, piecewise):
        assert sorted(found) == sorted(want)
        for row, r in want.items():
            assert {k: v for k, v in found[row].items() if k != "model"} == {k: v for k, v in r.items() if k != "model"}
            assert abs(found[row]["model"] - r["model"]) < 1e-4 * max(1, abs(r["model"]))
