"""Near-duplicates: a MinHash signature-coordinate inverted join, with links confirmed on the shingles themselves.

A document's set is that of its distinct word shingles. Documents with equal sets form a class, told by a 128-bit
BLAKE2b digest of the sorted 128-bit hashes of their shingles; its smallest id stands for it, so copies never
multiply. Representatives are posted under each (coordinate, value) of their signature. With ``M`` coordinates and
``T`` matches asked for, two documents must meet among the first ``M - T + 1`` coordinates of both, if each orders
its coordinates by how rare their values are; only these prefixes are posted. A pair's collisions in the posted
lists are counted; pairs that reach ``T`` there are kept, and for the others the lists that were skipped for their
length are probed in the two signatures. A pair of similarity 0.8 has fewer than ``T`` of ``M`` matches with
probability 2e-7. Only pairs whose sets are of sizes that allow the similarity are looked at.

No list is turned into all its pairs. Each list first links its members to its smallest and its largest
one (two stars). Pairs that then lie in one component need no further look. In lists that still hold more
than one component, short ones give their pairs across components; long ones are cut into packs of bounded
size, and each pair of packs meets in one task: first with signatures only, which names the members that have a
partner with ``T`` matches in another component; then these members' sets are compared, and one link per pair of
components comes back at most. There is no cap on lists or partners: the components are those of all links.

Every link is confirmed by comparing the words of both texts, shingle by shingle.

Edge cases: a null or empty text, or one of white space, has the empty set and is linked with nothing; a text
with fewer words than a shingle has one shingle, all its words; long texts are read in steps; rows that repeat an
id are judged by their own texts each, and two texts whose smallest id is the same count as linked; rows without an
id are alone; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import discard, materialize, trim_memory
from graphloom.llm.components import connected_components

M, T = 32, 13
SHORT_LIST = 16
PACK = 512
#: A list of at most so many ids (8 bytes each) is broadcast.
BROADCAST_IDS = 2_000_000
#: Bytes of a text that are cut into words at a time.
STEP = 1 << 20

_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 63, M, np.uint64)
_MUL = _rng.integers(0, 1 << 63, M, np.uint64) * np.uint64(2) + np.uint64(1)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words; ``bytes.split`` cuts at the same bytes.
GAP = r"[\x20\x09-\x0D]+"
_GAP = re.compile(GAP.encode())


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Distinct 128-bit hashes of the shingles of ASCII-lower-cased ``text``: rows of two numbers, in order."""
    data = (text or "").encode().lower()
    parts: list[bytes] = []
    held: list[bytes] = []
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + STEP)
        end = gap.start() if gap else len(data)
        held += data[at:end].split()
        at = end
        if len(held) >= words:
            shingles = zip(*(held[k : len(held) - words + 1 + k] for k in range(words)), strict=True)
            parts.append(b"".join(map(xxhash.xxh3_128_digest, map(b" ".join, shingles))))
            held = held[len(held) - words + 1 :]
    if held and not parts:
        parts.append(xxhash.xxh3_128_digest(b" ".join(held)))
    h = np.frombuffer(b"".join(parts), "<u8").reshape(-1, 2)
    h = h[np.lexsort((h[:, 1], h[:, 0]))]
    return h[np.concatenate([[True], (h[1:] != h[:-1]).any(1)])] if len(h) else h


def set_key(shingles: np.ndarray) -> bytes:
    """What equal sets have in common, and no others."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of ``M`` hash functions over the set."""
    own, out = np.ascontiguousarray(shingles[:, 0]), np.empty(M, np.uint64)
    for a in range(0, M, 8):
        out[a : a + 8] = ((_XOR[a : a + 8, None] ^ own) * _MUL[a : a + 8, None]).min(1)
    return out


def features(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, text_hash, n_shingles, set_key, sig array<long>)`` of every row; no key and signature for empty sets."""
    narrow = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, sig = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_hashes(text, words)
                n.append(len(s))
                key.append(set_key(s) if len(s) else None)
                sig.append(signature(s).astype(np.int64) if len(s) else None)
            columns = [batch.column("id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text_hash", "n_shingles", "set_key", "sig"])
        trim_memory()

    id_type = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {id_type}, text_hash long, n_shingles long, set_key binary, sig array<long>")


def sizes_fit(n: Column, other: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return (n * 100 >= other * percent) & (other * 100 >= n * percent)


def prefix_postings(reps: DataFrame) -> DataFrame:
    """``(c, v, rep, n)``: representatives under the coordinates of their prefix that others share."""
    posted = reps.select("rep", "n", F.posexplode("sig").alias("c", "v"))
    shared = posted.groupBy(F.col("c").alias("sc"), F.col("v").alias("sv")).agg(F.count("*").alias("df")).filter("df > 1")
    met = posted.join(shared, (F.col("c") == F.col("sc")) & (F.col("v") == F.col("sv")))
    rare_first = W.partitionBy("rep").orderBy("df", "c")
    ranked = met.withColumn("rank", F.row_number().over(rare_first) + M - F.count("*").over(W.partitionBy("rep")))
    return ranked.filter(F.col("rank") <= M - T + 1).select("c", "v", "rep", "n")


def collisions(met: DataFrame) -> DataFrame:
    """``(a, b, lists)`` of meetings ``(a, b, c)``: a bit for each coordinate in whose lists a pair collides."""
    return met.groupBy("a", "b").agg(F.bit_or(F.expr("shiftleft(1L, c)")).alias("lists"))


def alike(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` with ``T`` matches: those that have them in the posted lists ``(a, b, lists)``, and those
    for which probing the skipped lists, by the signatures, makes up the rest."""
    enough = F.bit_count("lists") >= T
    left = reps.select(F.col("rep").alias("a_id"), F.col("sig").alias("a_v"))
    right = reps.select(F.col("rep").alias("b_id"), F.col("sig").alias("b_v"))
    equal = F.size(F.filter(F.zip_with("a_v", "b_v", lambda x, y: x == y), lambda x: x))
    probed = pairs.filter(~enough).join(left, F.col("a") == F.col("a_id")).join(right, F.col("b") == F.col("b_id")).filter(equal >= T)
    return pairs.filter(enough).select("a", "b").union(probed.select("a", "b"))


def word_array(text: Column) -> Column:
    """The words of ASCII-lower-cased ``text``."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def shingle_array(words: str, k: int) -> Column:
    """Distinct shingles of a column of words, as strings."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))
    return F.when(n > 0, F.array_distinct(many)).otherwise(F.array().cast("array<string>"))


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose sets are similar enough, shingle by shingle; ``texts(id, w)`` has their words."""
    left = texts.select(F.col("id").alias("a_id"), F.col("w").alias("a_w"))
    right = texts.select(F.col("id").alias("b_id"), F.col("w").alias("b_w"))
    both = pairs.join(left, F.col("a") == F.col("a_id")).join(right, F.col("b") == F.col("b_id"))
    sets = both.select("a", "b", shingle_array("a_w", words).alias("a_v"), shingle_array("b_w", words).alias("b_v"))
    sizes = sets.select("a", "b", F.size(F.array_intersect("a_v", "b_v")).alias("n"), F.size("a_v").alias("na"), F.size("b_v").alias("nb"))
    return sizes.filter(F.col("n") * 100 >= (F.col("na") + F.col("nb") - F.col("n")) * percent).select("a", "b")


def rows_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text)`` of the documents in ``wanted(m)``, a written table. A list of ids that is short enough is
    broadcast, so the texts stay where they are; a longer one is joined by a shuffle."""
    chosen = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    few = wanted.count() <= BROADCAST_IDS
    return chosen.join(F.broadcast(wanted) if few else wanted, F.col("id") == F.col("m"), "left_semi")


def words_of(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, w)``: the words of the documents in ``pairs(a, b)``, written."""
    wanted = materialize(pairs.select(F.col("a").alias("m")).union(pairs.select("b")).distinct(), "wanted")
    out = materialize(rows_of(docs, wanted, id_col, text_col).select("id", word_array(F.col("text")).alias("w")), "words")
    discard(wanted)
    return out


def hash_sets(chosen: DataFrame, words: int) -> DataFrame:
    """``(id, shingles array<long>)``: a number for each shingle of ``chosen(id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.ascontiguousarray(shingle_hashes(t, words)[:, 0]).astype(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])
        trim_memory()

    return chosen.mapInArrow(run, "id long, shingles array<long>")


DEALT = ["c", "v", "low", "high"]


def dealt_packs(long: DataFrame, reps: DataFrame) -> DataFrame:
    """Lists ``(c, v, rep, n, component, members)`` cut into packs, a row for each pack and each pack that it meets:
    ``(c, v, low, high, pack, reps, components, sizes, sigs)``."""
    n_packs = F.ceil(F.col("members") / PACK).cast("int")
    signed = long.withColumn("packs", n_packs).join(reps.select(F.col("rep").alias("r"), "sig"), F.col("rep") == F.col("r"))
    packs = (
        signed.withColumn("pack", F.pmod(F.xxhash64("rep"), F.col("packs")).cast("int"))
        .groupBy("c", "v", "pack", "packs")
        .agg(F.collect_list(F.struct("rep", "component", "n", "sig")).alias("m"))
    )
    packs = packs.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("packs") - 1)))
    return packs.select(
        "c", "v", F.least("pack", "with").alias("low"), F.greatest("pack", "with").alias("high"), "pack", F.col("m.rep").alias("reps"),
        F.col("m.component").alias("components"), F.col("m.n").alias("sizes"), F.flatten(F.col("m.sig")).alias("sigs"),
    )


PROMISING = "c int, v long, low int, high int, pack int, rep long, component long, sig array<long>"


def _promising(percent: int):
    """Members of two packs of one list that have ``T`` matches with one of another component and of a size that fits."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = int(rows["low"].iloc[0]), int(rows["high"].iloc[0])
        of = {int(r.pack): (np.asarray(r.reps), np.asarray(r.components), np.asarray(r.sizes), np.asarray(r.sigs).reshape(-1, M)) for r in rows.itertuples()}
        packs, places, sigs = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)], []
        if i in of and j in of:
            (_, comp, size, sig), (_, other, sizes, signed) = of[i], of[j]
            hit, met = np.zeros(len(comp), bool), np.zeros(len(other), bool)
            for x in range(len(comp)):
                near = (other != comp[x]) & (sizes * 100 >= size[x] * percent) & (size[x] * 100 >= sizes * percent)
                near[near] = (signed[near] == sig[x]).sum(1) >= T
                hit[x] = near.any()
                met |= near
            for pack, mask in ((i, hit | met),) if i == j else ((i, hit), (j, met)):
                reps, components, _, own = of[pack]
                packs.append(np.full(mask.sum(), pack))
                places.append(np.stack([reps[mask], components[mask]], axis=1))
                sigs += list(own[mask])
        place, first = np.concatenate(places), rows.iloc[0]
        found = pd.DataFrame({"pack": np.concatenate(packs), "rep": place[:, 0], "component": place[:, 1], "sig": pd.Series(sigs, dtype=object)})
        return found.assign(c=first["c"], v=first["v"], low=i, high=j)

    return run


def _search_packs(percent: int):
    """Links between components among the promising members of two packs of one list."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = int(rows["low"].iloc[0]), int(rows["high"].iloc[0])
        comp, ids, pack = (rows[c].to_numpy() for c in ("component", "rep", "pack"))
        sets = [np.asarray(s, np.int64) for s in rows["shingles"]]
        size, sig = np.array([len(s) for s in sets]), np.stack([np.asarray(s, np.int64) for s in rows["sig"]])
        left, right = np.flatnonzero(pack == i), np.flatnonzero(pack == j)
        done: set[tuple[int, int]] = set()
        out: list[tuple[int, int]] = []
        for x in left:
            fits = (size[right] * 100 >= size[x] * percent) & (size[x] * 100 >= size[right] * percent)
            others = right[(comp[right] != comp[x]) & fits & ((ids[right] > ids[x]) if i == j else True)]
            matches = (sig[others] == sig[x]).sum(1)
            # the most alike first, so that few pairs of two components are compared
            for y in others[np.argsort(-matches, kind="stable")][: int((matches >= T).sum())]:
                key = (min(comp[x], comp[y]), max(comp[x], comp[y]))
                if key in done:
                    continue
                n, total = len(np.intersect1d(sets[x], sets[y], assume_unique=True)), size[x] + size[y]
                if n * 100 >= (total - n) * percent:
                    done.add(key)
                    out.append((int(ids[x]), int(ids[y])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def long_list_links(docs: DataFrame, long: DataFrame, reps: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``(a, b)``: links between components of one list, by packs."""
    promising = materialize(dealt_packs(long, reps).groupBy(*DEALT).applyInPandas(_promising(percent), PROMISING), "promising")
    wanted = materialize(promising.select(F.col("rep").alias("m")).distinct(), "wanted")
    sets = hash_sets(rows_of(docs, wanted, id_col, text_col), words)
    full = promising.join(sets, F.col("rep") == F.col("id")).select(*DEALT, "pack", "rep", "component", "sig", "shingles")
    out = materialize(full.groupBy(*DEALT).applyInPandas(_search_packs(percent), "a long, b long").distinct(), "across")
    discard(promising, wanted)
    return out


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", with_text_hash: bool = False) -> DataFrame:
    """``(id_col, n_shingles, component_id, kept)`` of every row, and ``text_hash``, the ``xxhash64`` of the row's
    text, if asked for; documents are linked if ``100 * common >= percent * union`` for their shingle sets. The
    result reads the written tables that its attribute ``tables`` lists; a caller may discard them afterwards."""
    known = materialize(features(docs, words, id_col, text_col), "features")
    classes = known.filter("n_shingles > 0 AND id IS NOT NULL").groupBy("set_key").agg(F.min(F.struct("id", "n_shingles", "sig")).alias("r"))
    classes = classes.select("set_key", F.col("r.id").cast("long").alias("rep"), F.col("r.n_shingles").alias("n"), F.col("r.sig").alias("sig"))
    classes = materialize(classes, "classes")
    reps = classes.select("rep", "n", "sig")

    postings = materialize(prefix_postings(reps), "postings")
    member = F.struct("rep", "n")
    lists = postings.groupBy("c", "v").agg(F.min(member).alias("low"), F.max(member).alias("high")).filter("low.rep < high.rep")
    ends = lists.select(F.col("c").alias("lc"), F.col("v").alias("lv"), F.inline(F.array(*[F.struct(F.col(f"{e}.rep").alias("hub"), F.col(f"{e}.n").alias("hub_n")) for e in ("low", "high")])))
    met = postings.join(ends, (F.col("c") == F.col("lc")) & (F.col("v") == F.col("lv")) & (F.col("rep") != F.col("hub")) & sizes_fit(F.col("n"), F.col("hub_n"), percent))
    stars = materialize(collisions(met.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"), "c")), "stars")

    near = materialize(alike(stars, reps), "near")
    texts = words_of(docs, near, id_col, text_col)
    first = materialize(confirmed(near, texts, words, percent).distinct(), "links")
    discard(near, texts)
    labels = connected_components(first)

    # lists that hold more than one component still
    placed = postings.join(labels, F.col("rep") == F.col("node"), "left").select("c", "v", "rep", "n", F.coalesce("component", "rep").alias("component"))
    placed = materialize(placed, "placed")
    mixed = placed.groupBy(F.col("c").alias("lc"), F.col("v").alias("lv")).agg(
        F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    mixed = mixed.filter("low < high").select("lc", "lv", "members")
    open_ = materialize(placed.join(mixed, (F.col("c") == F.col("lc")) & (F.col("v") == F.col("lv"))).select("c", "v", "rep", "n", "component", "members"), "open")

    short = open_.filter(F.col("members") <= SHORT_LIST)
    other = short.select(F.col("c").alias("oc"), F.col("v").alias("ov"), F.col("rep").alias("b"), F.col("n").alias("other_n"), F.col("component").alias("other"))
    in_list = (F.col("c") == F.col("oc")) & (F.col("v") == F.col("ov")) & (F.col("rep") < F.col("b")) & (F.col("component") != F.col("other"))
    across = short.join(other, in_list & sizes_fit(F.col("n"), F.col("other_n"), percent))
    across = materialize(collisions(across.select(F.col("rep").alias("a"), "b", "c")).join(stars, ["a", "b"], "left_anti"), "across")
    wide = long_list_links(docs, open_.filter(F.col("members") > SHORT_LIST), reps, words, percent, id_col, text_col)
    near = materialize(alike(across, reps).union(wide).distinct(), "near")
    texts = words_of(docs, near, id_col, text_col)

    links = materialize(first.union(confirmed(near, texts, words, percent)), "links")
    discard(labels, placed, open_, across, wide, near, texts, first, stars, postings)
    final = connected_components(links)
    discard(links)
    named = classes.join(final, F.col("rep") == F.col("node"), "left").select(F.col("set_key").alias("named_key"), F.coalesce("component", "rep").alias("component"))
    joined = known.drop("sig").join(named, F.col("set_key") == F.col("named_key"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    out = joined.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "text_hash")
    out = out if with_text_hash else out.drop("text_hash")
    out.tables = (known, classes, final)
    return out
