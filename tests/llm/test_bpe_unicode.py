"""Pieces by the library's own Unicode version, and the encoder of many pieces against that of one."""

import random

from tokenizers import Tokenizer

from scoregate.llm import bpe, bpe_model, queries


def test_every_code_point_is_cut_as_by_the_library():
    model = bpe_model.load(queries.vocabulary())
    cut, characters = model.cut(), bpe_model.byte_characters()
    library = Tokenizer.from_file(queries.vocabulary()).pre_tokenizer.pre_tokenize_str
    for low in range(0, 0x110000, 64):
        text = "".join(f"{chr(c)}'s a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}" for c in range(low, low + 64) if not 0xD800 <= c < 0xE000)
        if text:
            assert ["".join(characters[b] for b in p.encode()) for p in cut(text)] == [p for p, _ in library(text)], hex(low)


def test_many_pieces_together_give_what_each_gives_alone():
    model, rng = bpe_model.load(queries.vocabulary()), random.Random(4)
    pieces = ["".join(rng.choice("abcdeinorst  é日0") for _ in range(rng.randrange(0, 70))) for _ in range(3000)] + ["a" * n for n in range(140)] + [50256]
    one = bpe.piece_encoder(model)
    assert bpe.forest_encoder(model)(pieces) == [one(p) for p in pieces]


def test_memo_turns_over_without_losing_results():
    memo = bpe_model.Memo(str.upper, limit=3, longest=4)
    for batch in (["a", "b", "c"], ["d", "a"], ["e", "f", "toolong"], ["a", "d"]):
        memo.learn(batch, lambda pieces: [p.upper() for p in pieces])
        assert [memo[p] for p in batch] == [p.upper() for p in batch] and len(memo) <= 5
