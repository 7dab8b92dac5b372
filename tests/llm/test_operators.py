"""Operators against brute force, exact round trips and held-out accuracy."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations, product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sightline.llm import chat_format, decontam, exact_dedup, language_id, line_dedup, mixing, near_dup, quality, queries, token_counts, token_output
from rows import spark_rows, sql_rows

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"
BPE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    rows, _ = sql_rows(queries.ORACLE_SQL[name], SF)
    assert spark_rows(queries.QUERIES[name](spark, SF)) == rows


def test_token_counts_of_every_prefix(odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    rng = random.Random(1)
    alphabet = ["a", "the", " ", "  ", "\n", "'s", "'", "12", "é", "ß", "テ", "🙂", "<|endoftext|>", "\t", " ", "!?", "Token", "ization", " ", "é"]
    samples = ["".join(rng.choices(alphabet, k=rng.randint(1, 14))) for _ in range(150)]
    spark = odd.sparkSession
    docs = spark.createDataFrame(list(enumerate(samples)), "doc_id long, text string")
    for r in token_counts.prefix_token_counts(docs, BPE, limit=5).collect():
        text = samples[r["doc_id"]]
        want = [len(library.encode(text[:i], add_special_tokens=False)) for i in range(len(text) + 1)]
        assert [token_counts.tokens_at(r["prefix_deltas"], i) for i in range(len(text) + 1)] == want, text
        assert r["n_tokens"] == want[-1] and r["n_bytes"] == len(text.encode())
        assert r["fit_chars"] == max(i for i, n in enumerate(want) if n <= 5)


def test_token_counts_of_whole_texts(spark, odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        want = Counter((i, len(library.encode(t or "", add_special_tokens=False)), len((t or "").encode())) for i, t in texts(docs))
        got = Counter((r["doc_id"], r["n_tokens"], r["n_bytes"]) for r in token_counts.prefix_token_counts(docs, BPE).collect())
        assert got == want
    assert token_counts.prefix_token_counts(empty, BPE).count() == 0


def test_token_counts_of_long_pieces(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    rng = random.Random(5)
    short = "".join(rng.choices("abcde", k=300)) + "<|endoftext|>" + "x<|endof" + "<|endoftext|><|endoftext|>" + "".join(rng.choices("fgh12!", k=200))
    long = "".join(rng.choices("abcdefghij", k=1_000_000))
    long = long[:400_000] + "<|endoftext|>" + long[400_000:]
    df = spark.createDataFrame([(1, short), (2, long), (3, " \n" + short)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in token_counts.prefix_token_counts(df, BPE).collect()}
    for i, t in ((1, short), (3, " \n" + short)):
        assert [token_counts.tokens_at(got[i]["prefix_deltas"], k) for k in range(len(t) + 1)] == [len(library.encode(t[:k], add_special_tokens=False)) for k in range(len(t) + 1)]
    assert got[2]["n_tokens"] == len(library.encode(long, add_special_tokens=False))
    counts = token_counts.counter(BPE)
    assert max(map(len, counts.words), default=0) <= token_counts.LONGEST_KEPT
    small = token_counts.PrefixCounter(BPE, 3_000)
    for k in range(100):
        small.piece(f"word{k}")
    assert 0 < len(small.pieces) < 10


@pytest.mark.parametrize("hot_rows", [1, 500])
def test_exact_duplicates(odd, empty, hot_rows):
    groups = defaultdict(list)
    for i, t in texts(odd):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    got = exact_dedup.exact_duplicates(odd, hot_rows=hot_rows).collect()
    by_text = defaultdict(list)
    for r in got:
        by_text[r["text_sha256"]].append(r)
    assert sorted(len(g) for g in by_text.values()) == sorted(len(g) for g in groups.values())
    assert sorted((r["keep_id"] is None, r["keep_id"] or 0, r["group_size"]) for r in got) == sorted((k is None, k or 0, len(g)) for g in groups.values() for k in [min((i for i in g if i is not None), default=None)] * len(g))
    assert all(sum(r["kept"] for r in g) == 1 and {r["group_size"] for r in g} == {len(g)} for g in by_text.values())
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_simple8b_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 255, 256, 257, 5000):
        for bits in (1, 4, 16, 31, 61, 64):
            ids = rng.integers(0, 1 << bits, n, dtype=np.uint64) if bits < 64 else rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            payload, first = token_output.encode_ids(ids)
            assert np.array_equal(token_output.decode_ids(payload, first, n), ids)
    mixed = np.where(rng.random(4000) < 0.02, np.uint64((1 << 63) + 5), rng.integers(0, 60000, 4000, dtype=np.uint64))
    payload, first = token_output.encode_ids(mixed)
    assert np.array_equal(token_output.decode_ids(payload, first, len(mixed)), mixed)


def test_token_pages(spark, odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in token_output.read_token_pages(token_output.write_token_pages(docs, WORDS, 2)).collect()}
    start = 0
    for i, t in sorted(texts(docs)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    rows = token_output.read_token_pages(token_output.write_token_pages(odd, WORDS, 2)).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in texts(odd)), key=lambda i: (i is not None, i))
    assert Counter(r["n_tokens"] for r in rows) == Counter(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts(odd))
    assert token_output.read_token_pages(token_output.write_token_pages(empty, WORDS, 2)).count() == 0


def test_quality(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"{SF2}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.quality_scores(docs, labels)
    assert scored.count() == docs.count() and scored.where("score < 0 or score > 1 or score is null").count() == 0
    judged = scored.where("held_out").join(labels, "doc_id").where("quality in (0, 1)")
    right, all_ = judged.where("predicted = quality").count(), judged.count()
    assert all_ > 20 and right / all_ > 0.8
    one = labels.limit(0)
    assert quality.quality_scores(odd, one).select("score").distinct().count() == 1
    assert quality.quality_scores(odd, labels).count() == odd.count() and quality.quality_scores(empty, labels).count() == 0
    assert quality.good_documents(odd, labels).columns == odd.columns


def test_statistics_of_long_texts_as_of_short_ones(monkeypatch):
    rng = random.Random(3)
    samples = ["", " ", "\n\n", "one", " a b  a b a\tb\x0bé é\n\nline\nline ", *("".join(rng.choices(["a", "b", " ", "\n", "é", "word", "\t", "\r\n"], k=300)) for _ in range(30))]
    short = [quality.statistics(t) for t in samples]
    monkeypatch.setattr(quality, "LONG_TEXT", -1)
    assert [quality.statistics(t) for t in samples] == short


def test_mixing(spark, odd, empty):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    first = {r["doc_id"]: r for r in mixing.mix(docs)[0].collect()}
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(7))[0].collect()}
    assert {i: r["taken"] for i, r in first.items()} == again
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts(docs)}
    assert {i: r["size"] for i, r in first.items()} == sizes
    assert all(r["taken"] <= 2 * r["size"] for r in first.values())
    by_source = defaultdict(int)
    for r in first.values():
        by_source[r["source"], r["target"]] += r["taken"]
    assert all(abs(taken - target) <= 0.02 * target + 64 for (_, target), taken in by_source.items())
    assert mixing.mix(odd)[0].count() == odd.count() and mixing.mix(empty)[0].count() == 0
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    words = sum(len((r["text"] or "").split()) for r in mixed.collect())
    assert words == mixing.mix(odd)[0].agg(F.sum("taken")).first()[0]
    assert mixing.mixed_documents(empty).count() == 0


def hashed(*values):
    """Spark's xxhash64 of longs, ints and strings, chained from seed 42."""
    import xxhash

    h = 42
    for kind, v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if kind == "s" else v.to_bytes(8 if kind == "l" else 4, "little", signed=True), seed=h)
    return h - (1 << 64) if h >= 1 << 63 else h


def brute_mix(docs, seed=7, block=64):
    """(doc_id, text) -> words taken, one slot at a time: for tables of one chunk and one shard."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(t) for _, t, x in docs if x == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, rest = {}, 1.5 * sum(total.values())
    while True:
        free = [s for s in sources if s not in target]
        over = [s for s in free if rest * weight[s] > 2 * total[s] * sum(weight[x] for x in free)]
        if not over:
            target |= {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        share = sum(2 * total[s] for s in over)
        target |= {s: 2.0 * total[s] for s in over}
        rest -= share
    blocks = {s: -(-total[s] // block) for s in sources}
    expected = [target[s] * blocks[s] / total[s] if total[s] else 0.0 for s in sources]
    slots = round(sum(expected))
    p = [e / sum(expected) for e in expected]
    counts = [int(slots * x) for x in p]
    left = [slots * x - n for x, n in zip(p, counts)]
    for draw in range(1, slots - sum(counts) + 1):
        u = ((hashed(("i", seed), ("l", 0), ("i", draw)) & (1 << 64) - 1) >> 11) / float(1 << 53)
        edges, so_far = [], 0.0
        for x in left[:-1]:
            so_far += x / sum(left)
            edges.append(so_far)
        counts[sum(e <= u for e in edges)] += 1
    taken = Counter()
    for no, s in enumerate(sources):
        n, times = blocks[s], Counter()
        for slot in range(counts[no]):
            if slot // n < 2:
                x = slot % n
                for r in range(1, mixing.ROUNDS + 1):
                    partner = (hashed(("i", seed), ("i", no), ("l", slot // n), ("i", r)) % n - x) % n
                    if hashed(("i", seed), ("i", no), ("l", slot // n), ("i", r), ("l", max(x, partner))) % 2 == 0:
                        x = partner
                times[x] += 1
        at = 0
        for i, t, _ in sorted((d for d in docs if d[2] == s), key=lambda d: (d[0] is not None, d[0], hashed(("s", d[1] or "")))):
            for word in range(at, at + size(t)):
                taken[i, t] += times[word // block]
            at += size(t)
    return taken


def test_mixing_slot_by_slot(spark):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(None, "rows without an id " * 9, None), (None, None, "web")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    want = brute_mix(docs)
    by_hash = {(i, hashed(("s", t or ""))): want[i, t] for i, t, _ in docs}
    assert {(r["doc_id"], r["text_hash"]): r["taken"] for r in mixing.mix(df)[0].collect()} == by_hash


def test_mixing_one_document_under_two_sources(spark):
    docs = [(1, "both have these words", s) for s in ("a", "b", None)] + [(10 + i, f"w{i} " * 90, s) for i, s in enumerate(["a", "b", None] * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    taken = lambda rows: sorted(((r["doc_id"], str(r["source"]), r["n"]) for r in rows if r["n"]))
    want = taken(mixing.mix(df)[0].withColumn("n", F.col("taken")).collect())
    got = mixing.mixed_documents(df).withColumn("n", F.size(F.split("text", r"\s+"))).collect()
    assert Counter((r["doc_id"], str(r["source"])) for r in got) == Counter((i, s) for i, s, _ in want)
    assert sum(i == 1 for i, _, _ in want) > 1


def test_source_targets():
    for sizes in ([100, 100, 100], [10, 1000, 500, 0], [5], []):
        targets = mixing.source_targets(sizes)
        assert all(t <= 2 * s + 1e-9 for t, s in zip(targets, sizes))
        assert abs(sum(targets) - 1.5 * sum(sizes)) < 1e-6
    assert mixing.source_targets([100, 100, 100]) == [200.0, 250 / 3, 500 / 3]


def test_permutation(spark):
    got = [r[0] for r in spark.range(97).select(mixing.permuted(F.col("id"), F.lit(97), F.lit(3))).collect()]
    assert sorted(got) == list(range(97)) and got != sorted(got)


def brute_leak(doc, item):
    d, t = ([w for w in re.split(r"[^0-9a-z\u0080-\U0010ffff]+", (x or "").lower()) if w] for x in (doc, item))
    n = min(13, len(t))
    if len(t) < 8:
        return False
    return any(sum(a == b for a, b in zip(d[i : i + n], t[j : j + n])) == n for i in range(len(d) - n + 1) for j in range(len(t) - n + 1))


def test_decontamination(spark, odd, empty):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([5, 9, 13, 40])))) for k in range(12)] + [(99, None)]
    docs, planted = [], {}
    for i in range(60):
        body = rng.choices(vocab, k=rng.randint(0, 120))
        if i % 3 == 0:
            k, item = rng.choice(items[:12])
            words = item.split()
            if len(words) >= 30:
                words[len(words) // 2] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = words
            planted[i] = k
        docs.append((i, " ".join(body)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["contaminated"] for r in decontam.decontamination_report(d, b).collect()}
    want = {i: any(brute_leak(t, item) for _, item in items) for i, t in docs}
    assert got == want and any(want.values()) and not all(want.values())
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontam.decontaminated(odd, bench).columns == odd.columns and decontam.decontaminated(odd, bench).count() == odd.count()
    assert decontam.decontaminated(odd, spark.createDataFrame([(1, "THE quick, brown fox jumps over the lazy dog while seven bright lanterns swing")], "item_id long, text string")).count() == odd.count() - 5
    assert decontam.decontamination_report(empty, bench).count() == 0 and decontam.decontamination_report(odd, bench.limit(0)).where("contaminated").count() == 0


def brute_agreement(doc, item):
    """Whether a window of 13 words, or of the whole shorter item, agrees in 75% of its words at least."""
    d, t = doc.split(), item.split()
    n = min(13, len(t))
    return len(t) >= 8 and any(4 * sum(a == b for a, b in zip(d[i : i + n], t[j : j + n])) >= 3 * n for i in range(len(d) - n + 1) for j in range(len(t) - n + 1))


def test_decontamination_with_changed_words(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(3000)]
    items = [(n, " ".join(rng.choices(vocab, k=n))) for n in (*range(7, 17), 20, 30)]
    docs, ends = [], set()
    for k, item in items:
        words = item.split()
        n = min(13, k)
        for changed in [[0], [k - 1], [0, k - 1], [0, k // 2, k - 1], *(rng.sample(range(k), rng.randint(1, n - (3 * n + 3) // 4 + 1)) for _ in range(12))]:
            copy = [f"new{i}" if i in changed else w for i, w in enumerate(words)]
            if k >= 8 and changed in ([0], [k - 1]):
                ends.add(len(docs))
            docs.append((len(docs), " ".join([*rng.choices(vocab, k=rng.randint(0, 30)), *copy, *rng.choices(vocab, k=rng.randint(0, 30))])))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated_documents(d, b).collect()}
    assert got == {(i, k) for i, t in docs for k, item in items if brute_agreement(t, item)}
    assert ends <= {i for i, _ in got} and len({i for i, _ in got}) < len(docs)
    for n in range(8, 14):
        wrong = n - (3 * n + 3) // 4
        assert all(any(all(m[i] == "0" for i in c) for m in decontam.masks(n)) for c in combinations(range(n), wrong))


def test_language(spark, odd, empty):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    got = language_id.predicted_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(got) > 50 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.9
    odd_rows = language_id.predicted_languages(odd).collect()
    letterless = sum(1 for _, t in texts(odd) if not re.search(r"[^\W\d_]", t or ""))
    assert len(odd_rows) == odd.count() and sum(r["lang_pred"] == "und" for r in odd_rows) == letterless
    assert language_id.predicted_languages(empty).count() == 0


def test_language_learns_from_a_bounded_number_of_rows(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(language_id, "written", lambda df, label: kept.setdefault(label, df.cache()))
    base = spark.range(60).selectExpr("id as doc_id", "concat('alpha beta gamma delta ', cast(id as string)) as text", "if(id % 2 = 0, 'aa', 'bb') as lang", "'s' as source", "0L as n_chars")
    many = base.unionAll(base.selectExpr("doc_id", "concat(text, ' other') as text", "lang", "source", "n_chars").crossJoin(spark.range(40)).drop("id"))
    language_id.fit(many.repartition(8))
    learned = many.select("doc_id", "text", "lang").where(~quality.held_out("doc_id", 4, 2)).distinct()
    assert kept["language-sample"].count() <= learned.count() and kept["language-picked"].groupBy("learned").count().where(f"count > {language_id.BUCKETS * language_id.PER_BUCKET}").count() == 0
    assert kept["language-sample"].count() == kept["language-picked"].count()


def test_line_dedup(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, want = set(), {}
    for i, t in sorted(texts(docs)):
        if t is None:
            want[i] = None
            continue
        kept = []
        for c in line_dedup.chunks(t):
            key = "\n".join(c)
            if line_dedup.candidate(c):
                if key in seen:
                    continue
                seen.add(key)
            kept += c
        want[i] = "\n".join(kept)
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_chunks(docs.select("doc_id", "text")).collect()}
    assert got == want
    shared = "\n".join(f"shared line {k}" for k in range(30))
    two = spark.createDataFrame([(1, "first\n" + shared), (2, "shifted\nby one\n" + shared + "\nend")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in line_dedup.without_repeated_chunks(two).collect()}
    assert out[1]["n_removed_lines"] == 0 and out[2]["n_removed_lines"] >= 20
    cleaned = line_dedup.without_repeated_chunks(odd)
    assert cleaned.columns == [*odd.columns, "n_lines", "n_removed_lines"] and cleaned.count() == odd.count()
    assert line_dedup.without_repeated_chunks(empty).count() == 0


def brute_passages(docs):
    """Texts without the lines of any run of 2 to 8 lines, not all blank, that stands in a document before, or above it
    in its own."""
    seen, out = {}, {}
    for n, (i, t) in enumerate(sorted(docs)):
        lines, gone = t.split("\n"), set()
        for size in range(2, 9):
            for k in range(len(lines) - size + 1):
                run = tuple(lines[k : k + size])
                first = seen.setdefault(run, (n, k))
                if any(map(str.strip, run)) and (first[0] < n or first[1] + size <= k):
                    gone |= set(range(k, k + size))
        out[i] = "\n".join(line for k, line in enumerate(lines) if k not in gone)
    return out


def test_line_dedup_of_whole_passages(spark, odd, empty):
    rng = random.Random(8)
    passages = [[f"passage {p} line {k}" for k in range(n)] for p in range(6) for n in range(2, 9)]
    docs = [(i, "\n".join(line for _ in range(6) for line in [*(f"own {rng.random()}" for _ in range(rng.randint(1, 3))), *rng.choice(passages)])) for i in range(60)]
    docs += [(100 + i, "\n".join(rng.choices(["a", "b", "", " ", "c"], [2, 2, 3, 1, 1], k=rng.randint(1, 7)))) for i in range(80)]
    docs += [(300 + i, t) for i, t in enumerate(["x\nx\nx", "y\ny\ny\ny", "", "\n\n", "end\n\n\n\n", "top\n\n\n\nend", "q\nend\n\n\n"])]
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute_passages(docs)
    assert got[300] == "x\nx\nx" and got[301] == "y\ny" and got[306] == "q"
    cleaned = line_dedup.without_repeated_passages(odd)
    assert cleaned.columns == [*odd.columns, "n_lines", "n_removed_lines"] and cleaned.count() == odd.count()
    assert line_dedup.without_repeated_passages(empty).count() == 0


def test_line_dedup_of_pieces_with_one_hash(spark, odd, monkeypatch):
    """Pieces of other bytes under one hash are told apart by their texts."""
    want = spark_rows(line_dedup.without_repeated_passages(odd))
    rows = line_dedup.piece_rows
    monkeypatch.setattr(line_dedup, "piece_rows", lambda *a: rows(*a).withColumn("hash", F.lit(b"one")))
    assert spark_rows(line_dedup.without_repeated_passages(odd)) == want and any(r["n_removed_lines"] for r in line_dedup.without_repeated_passages(odd).collect())


def test_line_dedup_joined_by_salt(spark, monkeypatch):
    """A passage that stands in every document, joined in several tasks instead of a broadcast."""
    passage = "common line one\ncommon line two\ncommon line three"
    df = spark.createDataFrame([(i, f"own {i} a\n{passage}\nown {i} b") for i in range(60)], "doc_id long, text string")
    clean = lambda: sorted((r["doc_id"], r["text"], r["n_removed_lines"]) for r in line_dedup.without_repeated_passages(df).collect())
    want = clean()
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    assert clean() == want == [(i, f"own {i} a\n{passage}\nown {i} b" if i == 0 else f"own {i} a\nown {i} b", 3 * (i > 0)) for i in range(60)]


def brute_components(docs, size, similarity):
    sets = []
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= similarity * len(x | y):
                root[find(a)] = find(b)
    return [(i, len(s), min(sets[k][0] for k in range(len(sets)) if find(k) == find(j))) for j, (i, s) in enumerate(sets)]


def test_near_duplicates_of_a_dense_group(spark):
    rng = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    docs = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(30)}"
        docs.append((i, " ".join(words)))
    docs += [(1000 + i, " ".join(rng.choices(base, k=rng.randint(1, 40)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(df, 3, 85).collect())
    assert got == sorted(brute_components(docs, 3, 85))


def templated(kind, n):
    """Texts of one template of 200 words: 40 kinds of words in fixed slots or anywhere, put in, or paragraphs left out."""
    rng = random.Random(17)
    base = [f"t{i}" for i in range(200)]
    slots = rng.sample(range(5, 195), 8)
    docs = []
    for i in range(n):
        words = list(base)
        if kind == "slots":
            for at in slots:
                words[at] = f"k{rng.randrange(40)}"
        elif kind == "changed":
            for at in rng.sample(range(200), 5):
                words[at] = f"k{rng.randrange(40)}"
        elif kind == "put in":
            for at in sorted(rng.sample(range(200), 6), reverse=True):
                words.insert(at, f"k{rng.randrange(40)}")
        else:
            words = [w for p in range(20) if rng.random() < 0.85 for w in base[10 * p : 10 * p + 10]]
        docs.append((i, " ".join(words)))
    return docs


@pytest.mark.parametrize("kind", ["slots", "changed", "put in", "left out"])
def test_near_duplicates_of_a_template(spark, kind):
    docs = templated(kind, 200)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).collect())
    assert got == sorted(brute_components(docs, 3, 85))


def test_candidates_of_a_template_grow_with_its_documents(spark, monkeypatch):
    rows = []
    write = near_dup.written

    def counted(df, label):
        out = write(df, label)
        if label in ("near-pairs", "near-within", "near-next-members", "near-compared", "near-stars"):
            rows.append(out.count())
        return out

    monkeypatch.setattr(near_dup, "written", counted)
    made = []
    for n in (500, 1000, 2000):
        rows.clear()
        df = spark.createDataFrame(templated("slots", n), "doc_id long, text string").repartition(8)
        near_dup.near_duplicates(df, 3, 85).write.format("noop").mode("overwrite").save()
        made.append(sum(rows))
        # few texts have short lists, which give pairs; more texts have long ones, which give members: so many a text at most
        assert made[-1] <= 12 * n, made
    assert made[2] <= 2 * max(made[:2]), made


def test_near_duplicates_edges(odd, empty):
    got = near_dup.near_duplicates(odd, 5, 80).collect()
    assert len(got) == odd.count()
    assert all(r["n_shingles"] > 0 or r["kept"] for r in got)
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    kept = near_dup.one_of_each_group(odd, 5, 80)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 3 not in ids and {4, 5, 6, 7, 8} <= set(ids)
    assert near_dup.near_duplicates(empty).count() == 0


def test_near_duplicates_without_or_with_repeated_ids(spark):
    words = [f"n{i}" for i in range(60)]
    link = lambda a, b: " ".join([f"x{i}" for i in range(a)] + words[a : 60 - b] + [f"y{i}" for i in range(b)])
    other = " ".join(f"o{i}" for i in range(40))
    # 1 and 2 are linked through the text without id alone; 4 leads a group and repeats 3 under its own id
    docs = [(1, link(6, 0)), (2, link(0, 6)), (None, link(0, 0)), (None, link(0, 0)), (3, other), (4, other), (4, other + " more"), (4, "alone " * 9 + "one"), (4, "alone " * 9 + "one"), (5, "alone " * 9 + "one")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in near_dup.near_duplicates(df, 3, 80).collect()}
    assert [c for (i, _), c in got.items() if i in (1, 2, None)] == [1, 1, 1]
    kept = [(r["doc_id"], r["text"]) for r in near_dup.one_of_each_group(df, 3, 80).collect()]
    assert Counter(kept) == Counter([docs[0], docs[2], docs[3], docs[4], docs[7]])
    one = spark.createDataFrame([(7, link(0, 0)), (7, link(0, 1)), (8, link(1, 0))], "doc_id long, text string")
    assert near_dup.one_of_each_group(one, 3, 80).count() == 1


def brute_cost(roles):
    """The cheapest legal sequence by search over all choices of (role, join, empties before) for each turn and the end."""
    best = None
    for choice in product(range(len(chat_format.ACTIONS)), repeat=len(roles)):
        state, cost, ok = chat_format.START, 0, True
        for role, k in zip(roles, choice):
            taken, joins, empty = chat_format.ACTIONS[k]
            for e in empty:
                ok, state = ok and e in chat_format.FOLLOWS[state], chat_format.AFTER[e]
            ok = ok and (chat_format.AFTER[taken] == state if joins else taken in chat_format.FOLLOWS[state])
            state, cost = chat_format.AFTER[taken], cost + 1 * joins + 2 * len(empty) + 3 * (taken != role)
        if ok:
            cost += chat_format.END_COST[state]
            best = cost if best is None else min(best, cost)
    return best


def test_chat(spark):
    roles = ["system", "user", "assistant", "tool"]
    sequences = [s for n in (1, 2) for s in product(roles, repeat=n)] + [("user", "user", "system"), ("assistant", "assistant", "user")]
    turns = [(c, t, r, f"t{t}") for c, s in enumerate(sequences) for t, r in enumerate(s)]
    out = chat_format.repaired_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    costs = {r["conv_id"]: r["cost"] for r in out if r["cost"] is not None}
    assert costs == {c: brute_cost(s) for c, s in enumerate(sequences)}
    whole = defaultdict(str)
    for r in sorted(out, key=lambda r: (r["conv_id"], r["turn"])):
        whole[r["conv_id"]] += r["piece"]
    for text in whole.values():
        found = [r for r in re.findall(r"<\|(\w+)\|>\n", text) if r != "end"]
        assert re.fullmatch(r"(system,)?(user,assistant,)*", "".join(f"{r}," for r in found)), text


def test_chat_ties_over_partitions(spark):
    """Many texts under one turn and role lie in several partitions; they are in the order of their hashes."""
    texts_ = [f"t{i:05}" for i in range(3000)]
    df = spark.createDataFrame([(1, 0, "user", t) for t in texts_], "conv_id long, turn int, role string, text string").repartition(7)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = chat_format.repaired_turns(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    order = sorted(texts_, key=lambda t: (hashed(("s", t)), t))
    assert [next(t for t in (order[-1],) if t in r["piece"]) for r in rows if r["cost"] is not None] == [order[-1]]
    starts = [r["piece"] for r in rows if r["piece"].startswith("<|user|>")]
    assert len(starts) == 1 and order[0] in starts[0]


def test_chat_over_partitions_and_odd_rows(spark):
    turns = [(1, t, ("user", "assistant")[t % 2], "x") for t in range(4000)] + [(None, None, None, None), (None, 1, " GPT ", ""), (2, 1, "user", "a"), (2, 1, "user", "a")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    out = chat_format.repaired_turns(df).collect()
    assert len(out) == len(turns)
    assert [r["cost"] for r in out if r["conv_id"] == 1 and r["cost"] is not None] == [0]
    assert sorted(r["cost"] for r in out if r["conv_id"] == 2 and r["cost"] is not None) == [3]
    assert chat_format.repaired_turns(df.limit(0)).count() == 0
