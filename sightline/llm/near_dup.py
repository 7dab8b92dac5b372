"""Near-duplicate documents by an inverted join on signature coordinates.

A document is the set of its word shingles. Equal sets form one class at once; all further work is on classes. A class
has a signature of COORDINATES values, each the hash of ROWS MinHash values, and is posted under each of its values.

* A posting list of at most SHORT classes gives all its pairs.
* Longer lists are skipped in that merge. A pair that meets the match threshold m shares m values, so if one of its
  classes has fewer than m values with long lists, the two share a short list and were found there. Classes with m or
  more are dense; the rarest of their long lists (all but m - 1) are a prefix that every dense partner must share.
* Prefix lists join dense classes to families; a family may hold a third of all classes and is never held pair by pair.
  A family's centre is the shingles that more than half of its classes have, and a class is written as its difference
  from the centre. Two classes differ by what their differences do not share, so classes close to the centre are known
  to be linked through the closest one, and any other pair must share the more of their differences the farther out it
  lies. Differences, rarest shingle first, have a prefix in which any partner shares a shingle. The classes with a
  shingle in their prefixes are a smaller family with a centre of its own, at most half as large, and so on. Families of
  FEW classes at most are compared in one task; larger ones give their pairs only where these are fewer than the classes
  of all families that they would fall into. Equal families are looked at once. All bounds are exact.

Pairs are kept when at least m coordinates match, and become links when the whole sets, rebuilt from the texts, are as
similar as asked. m is the largest number that a pair of exactly that similarity misses with a chance of MISS at most.
Links become components by label propagation with pointer jumping. No pairs inside a class are made and no list, link
or component goes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, discard, written
from .token_counts import slices

COORDINATES = 32
ROWS = 4
SHORT = 8
#: Classes of a family that one task compares, all with all in one matrix product.
FEW = 64
BLOCK_SHINGLES = 8192
SALTS = 4
MISS = 1e-7
BROADCAST_LISTS = 1_000_000
BROADCAST_IDS = 1_000_000
SLICE_BYTES = 2_000_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def match_threshold(similarity: float) -> int:
    """The largest number of matching coordinates that a pair of this similarity misses with a chance of MISS at most."""
    p, below = similarity**ROWS, 0.0
    for m in range(COORDINATES + 1):
        below += comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)
        if below > MISS:
            return max(1, m)
    return COORDINATES


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text: words between ASCII white space, A-Z lower-cased."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    of_word = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in names), np.uint64, len(names))
    codes, edges = coded.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy()
    blank = np.fromiter((not w for w in names), bool, len(names))
    if blank.any():  # white space at either end of a text gives empty strings
        full = ~blank[codes]
        edges = np.concatenate([[0], np.cumsum(full)])[edges]
        codes = codes[full]
    hashes = of_word[codes]
    with np.errstate(over="ignore"):
        n = max(0, len(hashes) - size + 1)
        all_ = np.full(n, size, np.uint64)
        for i in range(size):
            all_ = mixed(all_ + hashes[i : i + n])
        sets = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a >= size:
                sets.append(np.unique(all_[a : b - size + 1]))
            elif b > a:
                one = np.full(1, b - a, np.uint64)
                for h in hashes[a:b]:
                    one = mixed(one + h)
                sets.append(one)
            else:
                sets.append(np.zeros(0, np.uint64))
    return sets


def signature(shingles: np.ndarray, factors: np.ndarray, terms: np.ndarray, block: int = 2048) -> np.ndarray:
    """COORDINATES hashes, each of ROWS MinHash values."""
    least = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(shingles), block):
        x = low[i : i + block, None] * factors + terms
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= high[i : i + block, None]
        x *= factors
        least = np.minimum(least, x.min(axis=0))
    rows = least.reshape(COORDINATES, ROWS).astype(np.uint64)
    out = np.arange(COORDINATES, dtype=np.uint64)
    for r in range(ROWS):
        out = mixed(out * _M1 + rows[:, r])
    return out


def described(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key, n_shingles, digest (of the whole set; null for an empty one), signature."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        rng = np.random.default_rng(2718)
        factors = rng.integers(0, 1 << 31, COORDINATES * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        terms = rng.integers(0, 1 << 32, COORDINATES * ROWS, dtype=np.uint64).astype(np.uint32)
        for whole in batches:
            for batch in slices(whole, SLICE_BYTES):
                sets = shingle_sets(batch.column(1), size)
                with np.errstate(over="ignore"):
                    signatures = [signature(s, factors, terms).view(np.int64) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()), pa.array(signatures, pa.list_(pa.int64()))],
                    names=["doc_id", "text_key", "n_shingles", "digest", "signature"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(describe, f"doc_id {kind}, text_key long, n_shingles long, digest binary, signature array<long>")


def whole_sets(docs: DataFrame, size: int, wanted: DataFrame) -> DataFrame:
    """digest, shingles of the classes in wanted (digest, rep, rep_key), rebuilt from a text of each."""
    n = wanted.count()
    reps = broadcast_if_small(wanted.select("rep", "rep_key").distinct(), n, BROADCAST_IDS)
    texts = docs.join(reps, docs["doc_id"].eqNullSafe(F.col("rep")) & (docs["text_key"] == F.col("rep_key")), "left_semi")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for whole in batches:
            for batch in slices(whole, SLICE_BYTES):
                sets = shingle_sets(batch.column(1), size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    names=["digest", "shingles"],
                )

    rebuilt = texts.mapInArrow(build, "digest binary, shingles array<long>")
    sets = written(rebuilt.join(broadcast_if_small(wanted.select("digest"), n, BROADCAST_IDS), "digest", "left_semi"), "near-sets")
    # repeated rows and rows without id may share a text; without them no set is shuffled
    return sets if sets.count() == n else written(sets.dropDuplicates(["digest"]), "near-distinct-sets")


def matching(pairs: DataFrame, classes: DataFrame, least: int, similarity: int) -> DataFrame:
    """Of pairs (a, b), those that match in at least `least` coordinates and whose set sizes allow the similarity."""
    one = classes.select("digest", "n_shingles", "signature")
    both = pairs.join(one.toDF("a", "n_a", "sig_a"), "a").join(one.toDF("b", "n_b", "sig_b"), "b")
    matches = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return both.where((100 * F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")) & (matches >= least)).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Of pairs (a, b), those whose whole sets have 100 * intersection >= similarity * union. Pairs are hashed and sets pass
    by, as sorting sets takes all the memory that it is given."""
    both = pairs.hint("shuffle_hash").join(sets.toDF("a", "set_a"), "a").hint("shuffle_hash").join(sets.toDF("b", "set_b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    both = both.withColumn("common", common).withColumn("all", F.size("set_a") + F.size("set_b") - F.col("common"))
    return both.where(100 * F.col("common") >= similarity * F.col("all")).select("a", "b")


def refined(members: DataFrame, n_families: int, similarity: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(links, pairs) as tables (a, b) of families: members has family, n, digest, size, label, apart.

    n is the family's number of classes. apart is the class's set, or its difference from any set that its family has in
    common. links are similar enough, as the sizes of differences prove or a comparison has shown. pairs holds other
    pairs that can be. Of all pairs, those are missing that components of links join anyway; classes of one label are
    known to be of one component.
    """
    more, less = F.lit(100 + similarity).cast("long"), F.lit(100 - similarity).cast("long")
    links, pairs = [], []
    while n_families:
        held = members.select("family", "n", F.explode("apart").alias("shingle")).groupBy("family", "n", "shingle").agg(F.count("*").alias("held")).where("held > 1")
        held = written(held, "near-held")
        n_held, n_common = held.agg(F.count("*"), F.count_if(F.expr("2 * held > n"))).first()
        # a centre has fewer than twice the shingles of its family's classes on average
        centres = held.where("2 * held > n").groupBy("family").agg(F.collect_list("shingle").alias("centre"))
        common = F.coalesce("centre", F.array().cast("array<long>"))
        moved = members.join(broadcast_if_small(centres, n_common, BROADCAST_IDS), "family", "left")
        moved = moved.select("family", "n", "digest", "size", "label", F.concat(F.array_except("apart", common), F.array_except(common, "apart")).alias("apart"))
        moved = written(moved.withColumn("excess", more * F.size("apart") - less * F.col("size")), "near-moved")
        closest = moved.groupBy("family").agg(F.min(F.struct("excess", "digest", "label")).alias("p")).select("family", F.col("p.excess").alias("excess_p"), F.col("p.digest").alias("p"), F.col("p.label").alias("label_p"))
        placed = moved.join(broadcast_if_small(closest, n_families, BROADCAST_IDS), "family")
        near = F.col("excess") + F.col("excess_p") <= 0
        # a partner shares so much of the difference: by the family's least excess, and by the partner's size
        shared = F.greatest(F.lit(1), F.ceil((F.col("excess") + F.col("excess_p")) / (2 * more)), F.ceil((similarity * F.col("excess") - 100 * less * F.col("size")) / (similarity * more)))
        placed = placed.select("family", "n", "digest", "size", F.when(near, F.col("label_p")).otherwise(F.col("label")).alias("label"), "apart", (F.size("apart") - shared + 1).cast("int").alias("prefix"), F.when(near & (F.col("digest") != F.col("p")), F.col("p")).alias("p"))
        placed = written(placed, "near-placed")
        links.append(written(placed.where(F.col("p").isNotNull()).select(*ordered("digest", "p")), "near-stars"))

        # classes by the shingles of their prefixes
        often = held.select("family", "shingle", F.when(F.expr("2 * held > n"), F.col("n") - F.col("held")).otherwise(F.col("held")).alias("held"))
        spread = placed.where("prefix > 0").select("family", "n", "digest", "size", "label", "prefix", F.explode("apart").alias("shingle"))
        ranked = spread.join(broadcast_if_small(often, n_held, BROADCAST_IDS), ["family", "shingle"], "left").withColumn("held", F.coalesce("held", F.lit(1).cast("long")))
        ranked = ranked.groupBy("family", "n", "digest", "size", "label", "prefix").agg(F.array_sort(F.collect_list(F.struct("held", "shingle"))).alias("order"))
        ranked = ranked.select("family", "n", "digest", "size", "label", F.explode(F.filter(F.slice("order", F.lit(1), F.col("prefix")), lambda x: x["held"] > 1)["shingle"]).alias("shingle"))
        ranked = written(ranked, "near-ranked")
        lists = ranked.groupBy("family", "shingle").agg(F.first("n").alias("n"), F.count("*").alias("n_next"), F.min("label").alias("low"), F.max("label").alias("high"), F.bit_xor(F.xxhash64("digest")).alias("x"), F.bit_xor(F.xxhash64("digest", F.lit(1))).alias("y"))
        lists = lists.where("low <> high").groupBy("n_next", "x", "y").agg(F.min(F.struct("family", "shingle", "n")).alias("l"))
        lists = written(lists.select("l.*", "n_next", F.concat_ws("-", F.hex("x"), F.hex("y"), "n_next").alias("next")), "near-next")
        flat = written(lists.groupBy("family", "n").agg(F.sum("n_next").alias("work")).where("work >= n * (n - 1) / 2").select("family"), "near-flat")
        n_flat = flat.count()
        going = lists.join(broadcast_if_small(flat, n_flat, BROADCAST_IDS), "family", "left_anti") if n_flat else lists
        n_going, n_families = going.agg(F.count("*"), F.count_if(F.col("n_next") > FEW)).first()
        one = ranked.drop("n").join(broadcast_if_small(going.drop("n"), n_going, BROADCAST_IDS), ["family", "shingle"])
        few = placed.join(one.where(F.col("n_next") <= FEW).select("family", "digest", "next"), ["family", "digest"])
        links.append(written(compared(few.select(F.col("next").alias("family"), "digest", "size", "label", "apart"), similarity), "near-compared"))
        if n_flat:
            whole = placed.join(broadcast_if_small(flat, n_flat, BROADCAST_IDS), "family", "left_semi").select("family", "digest", "size", "label")
            pairs.append(written(in_family(whole, "family", similarity), "near-pairs"))
        old = members
        if n_families:
            large = one.where(F.col("n_next") > FEW).select("family", "digest", "next", "n_next")
            members = written(placed.join(large, ["family", "digest"]).select(F.col("next").alias("family"), F.col("n_next").alias("n"), "digest", "size", "label", "apart"), "near-next-members")
        discard(old, held, moved, placed, ranked, lists, flat)
    return links, pairs


def shared_in_family(apart: list[np.ndarray]) -> np.ndarray:
    """How many values each two of one family's arrays share: products of presence matrices, BLOCK_SHINGLES values wide."""
    of_row = np.repeat(np.arange(len(apart)), [len(x) for x in apart])
    _, codes, held = np.unique(np.concatenate(apart), return_inverse=True, return_counts=True)
    often = held[codes] > 1
    codes, of_row, n = (np.cumsum(held > 1) - 1)[codes[often]], of_row[often], int((held > 1).sum())
    out = np.zeros((len(apart),) * 2, np.int64)
    for first in range(0, n, BLOCK_SHINGLES):
        here = (codes >= first) & (codes < first + BLOCK_SHINGLES)
        has = np.zeros((len(apart), min(BLOCK_SHINGLES, n - first)), np.float32)
        has[of_row[here], codes[here] - first] = 1
        out += np.rint(has @ has.T).astype(np.int64)
    return out


def shared_in_families(values: np.ndarray, family: np.ndarray, place: np.ndarray, n_families: int) -> np.ndarray:
    """The same for many families of SHORT classes at most, by family and places: each value has its family's classes as a
    set of bits, and equal sets of a family are counted once."""
    order = np.lexsort((values, family))
    values, family, bits = values[order], family[order], (1 << place[order]).astype(np.uint8)
    first = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (family[1:] != family[:-1])])) if len(values) else np.zeros(0, np.int64)
    sets = np.bitwise_or.reduceat(bits, first).astype(np.int64) if len(first) else np.zeros(0, np.int64)
    keys, times = np.unique(family[first].astype(np.int64) << 8 | sets, return_counts=True)
    out = np.zeros((n_families, SHORT, SHORT), np.int64)
    for i, j in combinations(range(SHORT), 2):
        both = (keys >> i) & (keys >> j) & 1 > 0
        np.add.at(out[:, i, j], keys[both] >> 8, times[both])
    return out


def compared(rows: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) that join all classes of rows (family, digest, size, label, apart) which are linked within a family of
    FEW classes at most; a link is left out where others and equal labels join its classes."""

    def whole_families(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        """Rows of whole families, with where each begins and the end."""
        rest = None
        for batch in batches:
            for part in slices(batch, SLICE_BYTES, 4):
                one = pa.Table.from_batches([part])
                table = one if rest is None else pa.concat_tables([rest, one]).combine_chunks()
                names = table.column("family").to_numpy()
                cuts = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1])
                if len(cuts) > 1:
                    yield table.slice(0, cuts[-1]).combine_chunks(), cuts
                rest = table.slice(cuts[-1])
        if rest is not None and rest.num_rows:
            yield rest.combine_chunks(), np.array([0, rest.num_rows])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_families(batches):
            digests, labels = table.column("digest").to_pylist(), table.column("label").to_pylist()
            size, lists = table.column("size").to_numpy().astype(np.int64), table.column("apart").chunk(0)
            length, flat = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()
            edges, n = np.concatenate([[0], np.cumsum(length)]), np.diff(cuts)
            root, out = {}, []

            def top(x: bytes) -> bytes:
                while root.get(x, x) != x:
                    x = root[x]
                return x

            def link(x: np.ndarray, y: np.ndarray, shared: np.ndarray) -> None:
                near = (100 - similarity) * (size[x] + size[y]) >= (100 + similarity) * (length[x] + length[y] - 2 * shared)
                for i, j in zip(x[near].tolist(), y[near].tolist()):
                    a, b = top(labels[i]), top(labels[j])
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        out.append((min(digests[i], digests[j]), max(digests[i], digests[j])))

            family = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(size)) - cuts[:-1][family]
            small = np.repeat((n <= SHORT)[family], length)
            shared = shared_in_families(flat[small], np.repeat(family, length)[small], np.repeat(place, length)[small], len(n))
            for i, j in combinations(range(SHORT), 2):
                here = np.flatnonzero((n > j) & (n <= SHORT))
                link(cuts[here] + i, cuts[here] + j, shared[here, i, j])
            for k in np.flatnonzero(n > SHORT).tolist():
                i, j = np.triu_indices(n[k], 1)
                link(cuts[k] + i, cuts[k] + j, shared_in_family([flat[edges[r] : edges[r + 1]] for r in range(cuts[k], cuts[k + 1])])[i, j])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["a", "b"])
        pa.default_memory_pool().release_unused()

    dealt = rows.select(F.xxhash64("family").alias("family"), F.col("family").alias("name"), "digest", "size", "label", "apart")
    dealt = dealt.repartition("family").sortWithinPartitions("family", "name").select(F.xxhash64("name", F.lit(1)).alias("family"), "digest", "size", "label", "apart")
    return dealt.mapInArrow(compare, "a binary, b binary")


def in_family(rows: DataFrame, family: str, similarity: int) -> DataFrame:
    """Pairs (a, b) of rows of one family that differ in label and whose sizes allow the similarity; SALTS tasks share a family."""
    left = rows.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)))
    right = rows.toDF(family, "p", "size_p", "label_p").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    both = left.join(right, [family, "salt"]).where("digest < p and label <> label_p")
    return both.where(100 * F.least("size", "size_p") >= similarity * F.greatest("size", "size_p")).select(*ordered("digest", "p"))


def ordered(a: str, b: str):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def components(links: DataFrame) -> DataFrame:
    """digest, label: equal labels are one component. Hooks labels along links and jumps pointers until no link differs."""
    edges = written(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("digest"), F.least("a", "near").alias("label")), "labels")
    n = labels.count()
    while True:
        seen = edges.join(broadcast_if_small(labels.toDF("a", "label_a"), n, BROADCAST_IDS), "a").join(broadcast_if_small(labels.toDF("b", "label_b"), n, BROADCAST_IDS), "b")
        apart = written(seen.where("label_a <> label_b").select("a", "label_a", "label_b"), "apart")
        n_apart = apart.count()
        if not n_apart:
            discard(edges, apart)
            return labels
        hooks = apart.select(F.col("a").alias("digest"), "label_b").unionAll(apart.select(F.col("label_a").alias("digest"), "label_b"))
        hooks = hooks.groupBy("digest").agg(F.min("label_b").alias("hook"))
        hooked = written(labels.join(broadcast_if_small(hooks, 2 * n_apart, BROADCAST_IDS), "digest", "left").select("digest", F.least("label", "hook").alias("label")), "hooked")
        up = hooked.select(F.col("digest").alias("label"), F.col("label").alias("root"))
        old, labels = labels, written(hooked.join(broadcast_if_small(up, n, BROADCAST_IDS), "label", "left").select("digest", F.least("label", "root").alias("label")), "labels")
        discard(apart, hooked, old)


def near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Sets are linked when 100 * intersection >= similarity * union. component_id is the smallest doc_id that links
    reach, of the same set too; kept is doc_id = component_id. A text with fewer words than a shingle is one shingle of
    all its words; null texts and texts without words have empty sets, link with nothing and stay. Null ids are never
    the smallest of others. Rows of one doc_id with other texts are rows of their own. Other columns are not read. An
    empty table gives an empty result.
    """
    return decided(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), shingle_words, similarity).drop("text_key", "group")


def decided(docs: DataFrame, shingle_words: int, similarity: int) -> DataFrame:
    """near_duplicates of docs (doc_id, text), with text_key, the text's hash, and group, equal for linked rows (null for
    a text without words)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    least = match_threshold(similarity / 100)
    rows = written(described(docs, shingle_words), "near-rows")
    classes = rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("rep_row"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = written(classes.select("digest", F.col("rep_row.doc_id").alias("rep"), F.col("rep_row.text_key").alias("rep_key"), "copies", "n_shingles", "signature"), "near-classes")

    # posting lists of two classes or more
    postings = classes.select("digest", F.explode("signature").alias("value"))
    lists = written(postings.groupBy("value").agg(F.count("*").alias("n_list")).where("n_list > 1"), "near-lists")
    n_lists = lists.count()
    members = written(postings.join(broadcast_if_small(lists, n_lists, BROADCAST_LISTS), "value"), "near-members")
    short, long = members.where(F.col("n_list") <= SHORT), members.where(F.col("n_list") > SHORT)
    within = short.select("value", F.col("digest").alias("a")).join(short.select("value", F.col("digest").alias("b")), "value").where("a < b").select("a", "b").distinct()
    within = written(matching(within, classes, least, similarity), "near-within")
    of_class = Window.partitionBy("digest")  # COORDINATES rows at most
    prefix = long.withColumn("n_long", F.count("*").over(of_class)).withColumn("rank", F.row_number().over(of_class.orderBy("n_list", "value")))
    prefix = written(prefix.where(F.col("rank") <= F.col("n_long") - (least - 1)).select("value", "digest"), "near-prefix")

    wanted = within.select(F.col("a").alias("digest")).unionAll(within.select("b")).unionAll(prefix.select("digest")).distinct()
    wanted = written(wanted.join(classes.select("digest", "rep", "rep_key"), "digest"), "near-wanted")
    sets = whole_sets(docs, shingle_words, wanted)

    # families of dense classes
    hubs = prefix.groupBy("value").agg(F.min("digest").alias("hub"))
    kin = components(prefix.join(broadcast_if_small(hubs, n_lists, BROADCAST_LISTS), "value").where(F.col("digest") != F.col("hub")).select(*ordered("digest", "hub")))
    families = kin.groupBy("label").agg(F.count("*").alias("n"))
    n_kin, n_families = kin.agg(F.count("*"), F.countDistinct("label")).first()
    members = sets.join(broadcast_if_small(kin.join(broadcast_if_small(families, n_families, BROADCAST_IDS), "label"), n_kin, BROADCAST_IDS), "digest").select(F.hex("label").alias("family"), "n", "digest", F.size("shingles").alias("size"), F.col("digest").alias("label"), F.col("shingles").alias("apart"))
    near, pairs = refined(written(members, "near-members"), n_families, similarity)
    pairs = reduce(DataFrame.unionAll, pairs, within.limit(0)).distinct().join(within, ["a", "b"], "left_anti")
    links = confirmed(within.unionAll(matching(pairs, classes, least, similarity)), sets, similarity)
    labels = components(written(reduce(DataFrame.unionAll, near, links), "near-links"))

    n_linked = labels.count()
    linked = classes.select("digest", "rep").join(broadcast_if_small(labels, n_linked, BROADCAST_IDS), "digest")
    roots = linked.groupBy("label").agg(F.min("rep").alias("component_id"))
    grouped = linked.join(broadcast_if_small(roots, n_linked, BROADCAST_IDS), "label").select("digest", "component_id", F.col("label").alias("group"))
    copies = classes.where("copies > 1").select("digest", F.col("rep").alias("component_id"), F.col("digest").alias("group")).join(broadcast_if_small(labels, n_linked, BROADCAST_IDS), "digest", "left_anti")
    found = written(grouped.unionAll(copies), "near-found")
    return (
        rows.select("doc_id", "text_key", "n_shingles", "digest")
        .join(broadcast_if_small(found, found.count(), BROADCAST_LISTS), "digest", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_key", F.coalesce("group", "digest").alias("group"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def one_of_each_group(docs: DataFrame, shingle_words: int = 5, similarity: int = 80) -> DataFrame:
    """The rows of docs, all columns, that stay: of each group the row with the smallest doc_id, of rows under
    that id one, and every row without words or id. An empty table stays empty."""
    decisions = written(decided(docs.select("doc_id", "text"), shingle_words, similarity).where("kept"), "near-kept")
    leads = decisions.where(F.col("n_shingles") > 0).where(F.col("doc_id").isNotNull())
    firsts = leads.groupBy("group").agg(F.min(F.struct("doc_id", "text_key")).alias("lead"))
    firsts = written(firsts.select(F.col("lead.doc_id").alias("__sightline_keep"), F.col("lead.text_key").alias("__sightline_key")), "near-leads")
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]") & F.col("doc_id").isNotNull()
    n = firsts.count()
    kept = docs.where(has_words).join(broadcast_if_small(firsts, n, BROADCAST_IDS), (docs["doc_id"] == F.col("__sightline_keep")) & (F.xxhash64(docs["text"]) == F.col("__sightline_key")), "left_semi")
    if n < leads.count():
        kept = kept.withColumn("__sightline_nth", F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("text"))).where("__sightline_nth = 1").drop("__sightline_nth")
    return kept.unionAll(docs.where(~has_words))
