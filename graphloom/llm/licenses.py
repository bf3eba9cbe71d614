"""License scans by diagonal voting.

All rolling 2-word grams of all texts are joined, on their hash and then on their words, to the positions of
the same grams in license templates. A meeting of word ``p`` of a text with word ``t`` of a template votes
for the diagonal ``p - t``. Votes are aggregated by diagonal; a diagonal with every gram of its template is a
place where the template stands word for word. A word added or missing shifts the rest of a match by one, so
neighbouring diagonals are merged into spans, of :data:`DRIFT` diagonals at most. A span is verified by an
alignment: the words that its votes tell (others count as unknown) are compared with the template's by edit
distance. What a span is worth is the smaller of the share of the template's grams that it holds and the share
of the template's words that the alignment leaves unedited.

The templates are a fixed list in this module or a caller's list; lists of up to :data:`BROADCAST_WORDS` words
are broadcast, longer ones are joined by a shuffle of the grams. Otherwise the only shuffle carries votes. A
text's votes are bounded by its own length.

Edge cases: a null or empty text has no words, no places and score 0; a text of one word has no gram; rows
that repeat an id and text give the same result each, rows that repeat an id with another text are told apart
by a hash of the text; a null id is an id like others; texts are read whole; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What stands between words, in ASCII-lower-cased text.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

BROADCAST_WORDS = 100_000

#: A span's diagonals lie so close together: so many words may be added to a match, or left out of it.
DRIFT = 4

UNKNOWN = "-"


def word_codes(words: list[str]) -> str:
    """A character for each word, the same for the same word."""
    known = list(dict.fromkeys(words))
    return "".join(chr(ord("a") + k) if k < 26 else chr(0x100 + k) for k in map(known.index, words))


@dataclass(frozen=True)
class Template:
    """Words of at least two that stand for a license; ``base`` ones must match word for word."""

    text: str
    label: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()


BASE = [
    Template("mit license", "mit", base=True),
    Template("apache license", "apache", base=True),
    Template("general public license", "gpl", base=True),
]

OWN = [
    Template("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    Template("licensed under the apache license version 2 0", "apache"),
    Template("gnu lesser general public license", "lgpl"),
    Template("gnu affero general public license", "agpl"),
    Template("redistribution and use in source and binary forms", "bsd"),
    Template("bsd license", "bsd"),
    Template("mozilla public license", "mpl"),
    Template("eclipse public license", "epl"),
    Template("creative commons attribution", "cc-by"),
    Template("licensed under cc by", "cc-by"),
    Template("all rights reserved", "all-rights-reserved"),
    Template("spdx license identifier", "spdx"),
]


def scan_licenses(
    docs: DataFrame,
    templates: list[Template] | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    drift: int = DRIFT,
    coverage: float = 0.8,
) -> DataFrame:
    """``(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score)`` of every row.

    A label of the method's own asks for a span that is worth ``coverage``; ``score`` is what the best span of
    the text is worth."""
    templates = BASE + OWN if templates is None else templates
    if any(len(t.words) < 2 for t in templates):
        raise ValueError("a template needs two words")
    spark = docs.sparkSession
    grams = spark.createDataFrame(
        [
            (k, t.label, t.base, word_codes(t.words), i, a, b)
            for k, t in enumerate(templates)
            for i, (a, b) in enumerate(zip(t.words, t.words[1:], strict=False))
        ],
        "template int, label string, base boolean, code string, at int, ta string, tb string",
    ).withColumn("gram", F.xxhash64("ta", "tb"))
    if sum(len(t.words) for t in templates) <= BROADCAST_WORDS:
        grams = F.broadcast(grams)

    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    words = keyed.select("id", "text_hash", F.array_remove(F.split(F.translate("text", UPPER, LOWER), GAP), "").alias("w"))
    rolling = words.filter(F.size("w") > 1).select(
        "id",
        "text_hash",
        F.posexplode(
            F.zip_with(
                F.slice("w", F.lit(1), F.size("w") - 1),
                F.slice("w", F.lit(2), F.size("w") - 1),
                lambda a, b: F.struct(F.xxhash64(a, b).alias("gram"), a.alias("a"), b.alias("b")),
            )
        ).alias("pos", "g"),
    )
    met = rolling.select("id", "text_hash", "pos", "g.*").join(grams, "gram").filter("a = ta AND b = tb")
    votes = met.select("id", "text_hash", "template", "label", "base", "code", "at", (F.col("pos") - F.col("at")).alias("diagonal"))
    keys = ["id", "text_hash", "template", "label", "base", "code"]
    diagonals = votes.groupBy(*keys, "diagonal").agg(F.collect_set("at").alias("ats"))

    near = W.partitionBy("id", "text_hash", "template").orderBy("diagonal").rangeBetween(0, drift)
    merged = diagonals.withColumn("near", F.collect_list(F.struct("diagonal", "ats")).over(near))
    worth = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(drift)), _span_worth))
    found = (
        merged.withColumns({"worth": worth, "exact": F.size("ats") == F.length("code") - 1})
        .withColumns({"is_base": F.col("base") & F.col("exact"), "own": ~F.col("base") & (F.col("worth") >= coverage)})
        .groupBy("id", "text_hash")
        .agg(
            F.count_if("is_base").alias("n_base"),
            F.min(F.when(F.col("is_base"), F.col("diagonal"))).alias("first_word"),
            F.max(F.when(F.col("is_base"), F.col("diagonal"))).alias("last_word"),
            F.array_join(F.sort_array(F.collect_set(F.when(F.col("is_base"), F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.sort_array(F.collect_set(F.when(F.col("is_base") | F.col("own"), F.col("label")))), ",").alias("labels"),
            F.max("worth").alias("score"),
        )
    )
    counted = keyed.select("id", "text_hash", F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long").alias("n_words"))
    found = found.withColumnsRenamed({"id": "fid", "text_hash": "fhash"})
    return counted.join(found, F.col("id").eqNullSafe(F.col("fid")) & (F.col("text_hash") == F.col("fhash")), "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _span_worth(width: Column) -> Column:
    """What the span of ``near``'s diagonals up to ``width`` above the first is worth."""
    own = F.filter("near", lambda d: d["diagonal"] <= F.col("diagonal") + width)
    votes = F.flatten(F.transform(own, lambda d: F.transform(d["ats"], lambda t: F.struct((d["diagonal"] + t).alias("p"), t.alias("t")))))
    places = F.transform(votes, lambda v: v["p"])
    share = F.size(F.array_distinct(F.transform(votes, lambda v: v["t"]))) / (F.length("code") - 1)

    def told(q: Column, back: int) -> Column:
        """The template's word that a vote at ``q - back`` tells of word ``q``."""
        vote = F.get(F.filter(votes, lambda v: v["p"] == q - back), F.lit(0))
        return F.substring(F.col("code"), vote["t"] + 1 + back, F.lit(1))

    span = F.transform(F.sequence(F.array_min(places), F.array_max(places) + 1), lambda q: F.coalesce(told(q, 0), told(q, 1), F.lit(UNKNOWN)))
    aligned = 1 - F.levenshtein("code", F.array_join(span, "")) / F.length("code")
    return F.greatest(F.lit(0.0), F.least(share, aligned))


def scan_sql(templates: list[Template] | None = None, drift: int = DRIFT, coverage: float = 0.8) -> str:
    """The same scan of ``documents`` in DuckDB SQL, by joining word pairs themselves; for templates of up to 26
    different words, since its edit distance counts bytes."""
    templates = BASE + OWN if templates is None else templates
    rows = ", ".join(
        f"({k}, '{t.label}', {t.base}, '{word_codes(t.words)}', {i}, '{a}', '{b}')"
        for k, t in enumerate(templates)
        for i, (a, b) in enumerate(zip(t.words, t.words[1:], strict=False))
    )
    return rf"""
WITH grams(template, label, base, code, nth, ta, tb) AS (VALUES {rows}),
docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAP}'), lambda x: x <> '') AS w
  FROM documents),
rolling AS (SELECT doc_id, w, unnest(range(1, len(w))) AS p FROM docs),
votes AS (
  SELECT doc_id, template, label, base, code, nth, p - 1 - nth AS diagonal
  FROM rolling JOIN grams ON w[p] = ta AND w[p + 1] = tb),
diagonals AS (
  SELECT doc_id, template, label, base, code, diagonal, list(DISTINCT nth) AS ats FROM votes GROUP BY ALL),
near AS (
  SELECT *, list({{'d': diagonal, 'ats': ats}}) OVER (PARTITION BY doc_id, template ORDER BY diagonal RANGE BETWEEN CURRENT ROW AND {drift} FOLLOWING) AS near
  FROM diagonals),
spans AS (
  SELECT *, flatten(list_transform(list_filter(near, lambda d: d.d <= diagonal + width), lambda d: list_transform(d.ats, lambda t: {{'p': d.d + t, 't': t}}))) AS vs
  FROM (SELECT *, unnest(range({drift} + 1)) AS width FROM near)),
coded AS (
  SELECT *, array_to_string(list_transform(range(list_min(list_transform(vs, lambda v: v.p)), list_max(list_transform(vs, lambda v: v.p)) + 2), lambda q: coalesce(
    substr(code, CAST(list_filter(vs, lambda v: v.p = q)[1].t AS BIGINT) + 1, 1), substr(code, CAST(list_filter(vs, lambda v: v.p = q - 1)[1].t AS BIGINT) + 2, 1), '{UNKNOWN}')), '') AS span
  FROM spans),
judged AS (
  SELECT doc_id, template, label, base, diagonal, any_value(len(ats) = length(code) - 1) AS exact,
         max(greatest(0, least(len(list_distinct(list_transform(vs, lambda v: v.t))) / (length(code) - 1), 1 - levenshtein(code, span) / length(code)))) AS worth
  FROM coded GROUP BY ALL),
found AS (
  SELECT doc_id,
         count(*) FILTER (WHERE base AND exact) AS n_base,
         min(diagonal) FILTER (WHERE base AND exact) AS first_word,
         max(diagonal) FILTER (WHERE base AND exact) AS last_word,
         array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE base AND exact)), ',') AS base_labels,
         array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE base AND exact OR NOT base AND worth >= {coverage})), ',') AS labels,
         max(worth) AS score
  FROM judged GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs LEFT JOIN found USING (doc_id)
"""
