"""License scans by ordered signature rules, from DataFrame functions alone.

Method: a text passes some gate, or no rule is tried. Of those that pass, the keywords that occur say which rules may
match, and only their expressions run, over the text's words with one space between (license_rules). Each match is an interval of
words. An interval that lies inside another one is suppressed, of equal ones all but the first rule's; of two neighbours left that
overlap in part, the one whose rule has priority stays. Intervals are sorted once and looked at by a running maximum of
their ends in a logarithmic number of passes, so that a text with many matches takes no work for pairs of them. Everything
stays in the row: nothing is shuffled, and no table is joined.

The base phrases are rules too, whose places are counted before any suppression; their labels always stay.

Defined cases: a null or empty text has no words and no places, empty labels and score 0; a text of any length is scanned
whole; repeated rows and null ids stay; an empty table gives an empty result; a column of the input named like a result
column is replaced by it, all others stay as they are."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from scoregate.llm.common import lower_ascii
from scoregate.llm.license_rules import BASE, GATES, RULES, SHORT_GATES, Rule

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_OPEN, _CLOSE = "\x01", "\x02"
_RULE = "array<struct<id: int, label: string, weight: double, keyword: string, pattern: string, base: boolean>>"
PLACE = "array<struct<start: int, turned: int, id: int, end: int, label: string, weight: double, base: boolean>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def _gated(low: Column) -> Column:
    out = F.lit(False)
    for gate in GATES:
        out = out | F.contains(low, F.lit(gate))
    return out | F.rlike(low, F.lit(rf"(?:^|[^a-z0-9])(?:{'|'.join(SHORT_GATES)})(?:[^a-z]|v|$)"))


def _places_of(words: Column, rule: Column) -> Column:
    """Where one rule matches: an array of places."""

    def marked(text: Column) -> Column:
        parts = F.split(text, " ")
        at = lambda found: F.filter(F.transform(parts, lambda w, i: F.when(found(w), i)), lambda i: i.isNotNull())
        starts, ends = at(lambda w: F.startswith(w, F.lit(_OPEN))), at(lambda w: F.endswith(w, F.lit(_CLOSE)))
        return F.zip_with(
            starts,
            ends,
            lambda s, e: F.struct(
                s.alias("start"), (-e).alias("turned"), rule["id"].alias("id"), e.alias("end"), rule["label"].alias("label"),
                rule["weight"].alias("weight"), rule["base"].alias("base")
            )
        )

    found = _let(F.regexp_replace(words, rule["pattern"], F.lit(f"{_OPEN}$0{_CLOSE}")), marked)
    return F.when(F.rlike(words, rule["pattern"]), found).otherwise(F.array().cast(PLACE))


def _resolved(places: Column) -> Column:
    """What stands of sorted places."""
    passes = F.ceil(F.log2(F.size(places).cast("double"))).cast("int")
    steps = F.when(F.size(places) > 1, F.sequence(F.lit(0), passes - 1)).otherwise(F.array().cast("array<int>"))
    widen = lambda ends, p: F.transform(ends, lambda x, i: F.greatest(x, F.get(ends, i - F.call_function("shiftleft", F.lit(1), p))))
    furthest = F.aggregate(steps, F.transform(places, lambda d: d["end"]), widen)

    def neighbours(left: Column) -> Column:
        def stands(d: Column, i: Column) -> Column:
            before, after = F.get(left, i - 1), F.get(left, i + 1)
            worse = (before["end"] >= d["start"]) & (before["id"] < d["id"])
            return ~F.coalesce(worse, F.lit(False)) & ~F.coalesce((after["start"] <= d["end"]) & (after["id"] < d["id"]), F.lit(False))

        return F.filter(left, stands)

    outer = lambda ends: F.filter(places, lambda d, i: ~F.coalesce(F.get(ends, i - 1) >= d["end"], F.lit(False)))
    return _let(_let(furthest, outer), neighbours)


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def license_scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, text: str = "text") -> DataFrame:
    """The documents with n_words, n_base, first_word, last_word, base_labels, labels, score (the surest place's weight) and places:
    an array of (label, start, end, weight, rule), words counted from 0, of what stands after suppression, in order of start.

    rules: in order of priority; base: those of them whose places are counted and whose labels stay."""
    held = [
        {
            "id": i,
            "label": r.label,
            "weight": r.weight,
            "keyword": r.keyword,
            "pattern": rf"(?<![^ ])(?:{r.pattern})(?![^ ])",
            "base": r in base
        }
        for i, r in enumerate(rules)
    ]
    table = F.from_json(F.lit(json.dumps(held)), _RULE)
    keywords = F.from_json(F.lit(json.dumps(sorted({r.keyword for r in rules}))), "array<string>")
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.trim(F.regexp_replace(lower_ascii(raw), F.lit(_BETWEEN), F.lit(" ")))

    def tried(low: Column) -> Column:
        asked = lambda hits: F.filter(table, lambda r: F.array_contains(hits, r["keyword"]))
        some = _let(F.filter(keywords, lambda k: F.contains(low, k)), asked)
        found = _let(words, lambda w: F.array_sort(F.flatten(F.transform(some, lambda r: _places_of(w, r)))))
        return F.when(_gated(low), found).otherwise(F.array().cast(PLACE))

    def digest(all_places: Column) -> Column:
        own = F.filter(all_places, lambda d: d["base"])

        def told(left: Column) -> Column:
            label = lambda d: d["label"]
            starts = F.transform(own, lambda d: d["start"].cast("long"))
            return F.struct(
                F.size(own).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                _joined(F.transform(own, label)).alias("base_labels"), _joined(F.transform(F.concat(own, left), label)).alias("labels"),
                F.coalesce(F.array_max(F.transform(F.concat(own, left), lambda d: d["weight"])), F.lit(0.0)).alias("score"),
                F.transform(
                    left,
                    lambda d: F.struct(
                        label(d).alias("label"),
                        d["start"].alias("start"),
                        d["end"].alias("end"),
                        d["weight"].alias("weight"),
                        d["id"].alias("rule")
                    )
                ).alias("places"),
            )

        return _let(_resolved(all_places), told)

    results = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places")
    rest = [F.col(f"`{c}`") for c in documents.columns if c not in results]
    found = F.struct(F.regexp_count(raw, F.lit(_WORD)).cast("long").alias("n_words"), _let(_let(F.lower(raw), tried), digest).alias("found"))
    out = documents.select(*rest, found.alias("__sg_scan"))
    return out.select(*rest, "__sg_scan.n_words", "__sg_scan.found.*")
