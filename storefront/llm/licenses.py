"""License scans by ordered signature rules.

The words of a text (lower case, one blank between two) are read by hundreds of
regular expressions, each only where the keyword of its section occurs. Where
detections overlap, one that lies within another of the same or a better rank is
suppressed; of two on the same interval the earlier rule stays. Four base phrases are
reported whatever suppresses them.

Main path: DataFrame functions only, on each text's own row, nothing is shuffled.
A text that holds no keyword costs a few searches and a count of its words.

Defined cases: a null or empty text, or one without words, has no places, no labels
and the score 0; every place counts, also where phrases share words; repeated rows
and equal or null ids each give a row of their own; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storefront.functions.binding import let, settled
from storefront.llm.license_rules import LICENSE_RULES, LicenseRule

# What parts words, in lower-cased text, and the phrases always reported.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE_PHRASES: Mapping[str, str] = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: How sure a detection of each rank is.
CONFIDENCE = (1.0, 0.9, 0.75, 0.5, 0.25)

_PLACE = "struct<beg:int,back:int,rank:int,number:int,label:string>"


def normal(text: Column) -> Column:
    """The words with a blank before, between and after them."""
    lower = F.translate(text, ascii_uppercase, ascii_lowercase)
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(lower, BETWEEN, " "), F.lit(" ")), F.lit(" "))


def may_match(text: Column, keywords: Sequence[str]) -> Column:
    """Whether all words of some keyword occur somewhere: true wherever the keyword does."""

    def occurs(lower: Column) -> Column:
        return reduce(or_, [reduce(and_, [lower.contains(w) for w in k.split()]) for k in sorted(set(keywords))])

    return let(F.lower(text), occurs)


def _places(text: str, expression: str, fields: str) -> str:
    """SQL array of an expression's places in ``text``, whole words only.

    Matches and the pieces between them alternate; their lengths add up to positions.
    ``back`` is the end, negative, so that the longer of two with one beginning sorts first.
    """
    pattern = f"concat(' (?:', {expression}, ')(?= )')"
    found = f"regexp_extract_all({text}, {pattern}, 0)"
    return f"""
    transform(array({found}), hits -> CASE WHEN size(hits) = 0 THEN cast(array() AS array<{_PLACE}>) ELSE
      aggregate(
        zip_with(slice(split({text}, {pattern}, -1), 1, size(hits)), hits,
                 (gap, hit) -> struct(length(gap) AS gap, length(hit) AS size)),
        struct(0 AS at, cast(array() AS array<{_PLACE}>) AS out),
        (acc, x) -> struct(acc.at + x.gap + x.size AS at,
                           concat(acc.out, array(struct(acc.at + x.gap AS beg, -(acc.at + x.gap + x.size) AS back,
                                                        {fields}))) AS out),
        acc -> acc.out) END)[0]"""


def _literal(value: object, kind: str) -> str:
    table = json.dumps(value).replace("'", "\\u0027")
    return f"from_json(r'{table}', '{kind}')"


def detections(text: str, rules: Sequence[LicenseRule]) -> Column:
    """All places of all rules in the normal text of column ``text``, in order."""
    sections: dict[str, list[dict]] = {}
    for rule in rules:
        one = {"number": rule.number, "rank": rule.rank, "label": rule.label, "expression": rule.expression}
        sections.setdefault(rule.keyword, []).append(one)
    table = _literal(
        [{"keyword": k, "rules": r} for k, r in sections.items()],
        "array<struct<keyword:string,rules:array<struct<number:int,rank:int,label:string,expression:string>>>>",
    )
    places = _places(text, "rule.expression", "rule.rank AS rank, rule.number AS number, rule.label AS label")
    return F.expr(
        f"""array_sort(flatten(transform(
              flatten(transform(filter({table}, s -> contains({text}, s.keyword)), s -> s.rules)),
              rule -> {places})))"""
    )


def unsuppressed(places: str) -> Column:
    """The places, in order, without those that lie within one of the same or a better rank.

    In this order whatever holds a place comes before it, so one pass that knows how
    far each rank has reached is enough.
    """
    ranks = len(CONFIDENCE)
    return F.expr(
        f"""
        aggregate({places},
          struct(array_repeat(0, {ranks}) AS reach, cast(array() AS array<{_PLACE}>) AS out),
          (acc, h) -> CASE WHEN exists(slice(acc.reach, 1, h.rank + 1), e -> e >= -h.back) THEN acc ELSE
            struct(transform(acc.reach, (e, i) -> CASE WHEN i = h.rank THEN greatest(e, -h.back) ELSE e END) AS reach,
                   concat(acc.out, array(h)) AS out) END,
          acc -> acc.out)"""
    )


def base_places(text: str, phrases: Mapping[str, str]) -> Column:
    """All places of the phrases in the normal text of column ``text``, in order."""
    fields = "0 AS rank, 0 AS number, '{}' AS label"
    each = [
        _places(text, f"r'{re.escape(phrase).replace(chr(92) + ' ', ' ')}'", fields.format(label))
        for phrase, label in phrases.items()
    ]
    return F.expr(f"array_sort(concat({', '.join(each)}))")


def scan_licenses(
    docs: DataFrame, rules: Sequence[LicenseRule] = LICENSE_RULES, phrases: Mapping[str, str] = BASE_PHRASES
) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_found, detections``.

    ``n_base`` places of the base phrases, the first and last word they start at (from
    0), their labels; ``labels`` has those of the rules too. ``score`` is how sure the
    best detection is. ``detections`` are those left after suppression: place in the
    normal text, rank, rule and label.
    """
    text = F.coalesce("text", F.lit(""))
    worth = may_match(text, [*(r.keyword for r in rules), *phrases])
    read = docs.select(
        F.col("doc_id"),
        F.size(F.array_remove(F.split(text, BETWEEN_ANY_CASE), "")).cast("long").alias("n_words"),
        F.when(worth, normal(text)).alias("_normal"),
    )
    # each array is made once: later steps are kept from being merged into earlier ones
    read = settled(read)
    none = F.expr(f"cast(array() AS array<{_PLACE}>)")
    placed = settled(
        read.select(
            "*",
            F.when(F.col("_normal").isNull(), none).otherwise(base_places("_normal", phrases)).alias("_base"),
            F.when(F.col("_normal").isNull(), none).otherwise(detections("_normal", rules)).alias("_found"),
        )
    )
    kept = settled(placed.withColumn("_kept", unsuppressed("_found")))

    def word_at(place: Column) -> Column:
        return F.regexp_count(F.substr("_normal", F.lit(1), place["beg"]), F.lit(" ")).cast("long")

    def labels(*places: str) -> Column:
        every = F.concat(*(F.transform(p, lambda x: x["label"]) for p in places))
        return F.array_sort(F.array_distinct(every))

    best = F.array_min(F.transform("_kept", lambda x: x["rank"]))
    score = F.coalesce(F.get(F.array(*map(F.lit, CONFIDENCE)), best), F.lit(0.0))
    spans = F.transform(
        "_kept",
        lambda x: F.struct(
            x["beg"].alias("beg"), (-x["back"]).alias("end"), x["rank"].alias("rank"), x["number"].alias("rule"), x["label"].alias("label")
        ),
    )
    return kept.select(
        "doc_id",
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        word_at(F.get("_base", F.lit(0))).alias("first_word"),
        word_at(F.get("_base", F.size("_base") - 1)).alias("last_word"),
        labels("_base").alias("base_labels"),
        labels("_base", "_kept").alias("labels"),
        score.alias("score"),
        F.size("_found").cast("long").alias("n_found"),
        spans.alias("detections"),
    )
