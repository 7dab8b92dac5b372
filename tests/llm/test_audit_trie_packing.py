"""The filter audit, the prefix trie and best-fit packing, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest

from sightline.llm import filter_audit, packing, prefix_trie, queries

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute_audit(docs, labels):
    """docs: doc_id, text, lang. Every document is taken through every order."""
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    out, parts = defaultdict(Counter), {lang or "" for _, _, lang in docs}
    shapley = Counter()
    for i, text, lang in docs:
        text, part = text or "", lang or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        }
        for order in permutations("ABCDE"):
            gone = False
            for step, x in enumerate(order, 1):
                key = (part, "".join(order), step)
                removed = fails[x] and not gone
                out[key] += Counter(redundant=fails[x] and gone, removed=removed, unique_fails=fails[x] and sum(fails.values()) == 1, good_lost=removed and i in good, toxic_lost=removed and i in toxic)
                gone = gone or removed
                out[key]["kept"] += not gone
                shapley[part, x] += removed
    rows = {}
    for part in parts:
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                key = (part, "".join(order), step)
                rows[key] = tuple(int(out[key][k]) for k in COUNTS[:-1]) + (shapley[part, x],)
    return rows


def test_filter_audit(spark, odd, empty):
    long = " ".join(f"W{i}" for i in range(120))
    docs = [(i, t, lang) for i, t, lang in [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]] + [(20, long, "de"), (21, long, "fr"), (22, long + " #", "de"), (-1, long, None), (23, "A" * 30, "de"), (None, long, "de"), (24, "x " * 150, "de")]
    labels = [(20, 1, 0), (20, 0, 1), (21, 1, 1), (24, None, None), (None, 1, 1), (99, 1, 1)]
    df = spark.createDataFrame([(*d, "y", True, 1) for d in docs], "doc_id long, text string, lang string, part string, E boolean, step int").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.filter_interactions(filter_audit.filter_flags(df, marks), len(docs)).collect()
    assert len(got) == len({d[2] for d in docs}) * 600
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[k] for k in COUNTS) for r in got} == brute_audit(docs, labels)
    assert all(r["filter"] == r["filter_order"][r["step"] - 1] for r in got)
    assert filter_audit.filter_interactions(filter_audit.filter_flags(empty, marks), 0).count() == 0


def brute_trie(turns):
    """turns: conv_id, turn, role, text. Nodes as sequences, all conversations compared with all nodes."""
    own = defaultdict(list)
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()
    for c, turn, role, text in sorted(turns, key=lambda x: (x[1] is not None, x[1] or 0, digest(x[2] or "", x[3] or ""))):
        if c is not None:
            own[c].append((role or "", text or ""))
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        seqs[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    nodes = {s[:d] for s in seqs.values() for d in range(len(s) + 1)}
    members = {n: sorted(c for c, s in seqs.items() if s[: len(n)] == n) for n in nodes}
    parents = Counter(n[:-1] for n in nodes if n)
    rows = []
    for n in nodes:
        under = [m for m in nodes if m[: len(n)] == n]
        rows.append(
            (members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), parents[n], sum(not parents[m] for m in under), sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in under if m),
             hashlib.sha256(",".join(str(c) for c in members[n] if seqs[c] == n).encode()).hexdigest())
        )
    return Counter(rows)


def trie_rows(df):
    return Counter(tuple(r[k] for k in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect())


def some_conversations():
    rng = random.Random(5)
    turns = [(c, t, rng.choice(["user", "bot"]), rng.choice(["a", "é", "long text here"])) for c in range(60) for t in range(rng.randint(1, 9))]
    turns += [(100 + c, t, "user", f"same {t}") for c in range(40) for t in range(4)]  # a group of copies
    turns += [(200 + c, 0, "user", "common start") for c in range(40)] + [(200 + c, 1, None, f"own {c}") for c in range(20)]
    turns += [(300, t, "user", f"chain {t}") for t in range(120)] + [(301, None, "user", None), (301, 0, None, ""), (301, 0, None, ""), (301, 0, "user", "tie")]
    turns += [(None, 0, "user", "nobody"), (403, 0, "", "x"), (None, None, None, None)]
    rng.shuffle(turns)
    return turns


@pytest.mark.parametrize("stem_turns", [3, 40, 100_000])
def test_prefix_trie(spark, monkeypatch, stem_turns):
    monkeypatch.setattr(prefix_trie, "PIECE_CHARS", 20)
    turns = some_conversations()
    df = spark.createDataFrame([(*t, "p", 1) for t in turns], "conv_id long, turn long, role string, text string, stem string, pos int").repartition(5)
    got = prefix_trie.prefix_trie(*prefix_trie.spliced(df), stem_turns=stem_turns)
    assert trie_rows(got) == brute_trie(turns)


def test_prefix_trie_of_a_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert trie_rows(queries.op12_prefix_trie(spark, SF)) == brute_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert prefix_trie.prefix_trie(*prefix_trie.spliced(df.limit(0))).count() == 0


def lower_bound(counts, capacity):
    return -(-sum(s * n for s, n in counts.items()) // capacity)


def first_fit_decreasing(counts, capacity):
    room = []
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        at = next((i for i, r in enumerate(room) if r >= s), None)
        if at is None:
            room.append(capacity - s)
        else:
            room[at] -= s
    return len(room)


def check_plan(counts, capacity):
    plan, sequences = packing.packing_plan(dict(counts), capacity)
    taken, filled = defaultdict(list), defaultdict(list)
    for p in plan:
        taken[p.length] += range(p.first, p.first + p.n)
        for i in range(p.n):
            filled[p.sequence + i // p.per_sequence].append((p.offset + i % p.per_sequence * p.length, p.length))
    assert {s: sorted(x) for s, x in taken.items()} == {s: list(range(n)) for s, n in counts.items() if n}
    assert set(filled) == set(range(sequences))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def test_packing_plan():
    rng = random.Random(3)
    for _ in range(12):
        capacity = rng.choice([64, 300, 4096])
        lengths = [max(1, min(capacity, int(rng.lognormvariate(np.log(capacity / rng.choice([2, 4, 9])), 0.9)))) for _ in range(rng.randint(1, 900))]
        counts = Counter(lengths)
        n = check_plan(counts, capacity)
        ffd = first_fit_decreasing(counts, capacity)
        assert lower_bound(counts, capacity) <= n <= ffd + 1, (capacity, n, ffd)
    assert check_plan({}, 4096) == 0
    # thirds of a sequence: rounding up within groups costs at most a group
    assert check_plan(Counter(rng.randint(1300, 1365) for _ in range(3000)), 4096) == 1000
    # lengths that first fit decreasing packs badly: 6 / 7 of its sequences are enough
    assert check_plan({2051: 420, 1030: 420, 1015: 420}, 4096) <= 421


def whole_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids + [1]


def test_packing_of_documents(odd, empty):
    got = packing.packed_documents(odd, WORDS, end_id=1)
    rows = got.pieces.collect()
    want = Counter()
    for r in odd.collect():
        ids = whole_ids(r["text"])
        for k in range(0, len(ids), 4096):
            want[r["doc_id"], k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    at = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 4096 and len(at) == got.sequences
    for s in packing.packed_sequences(got).collect():
        ids, first = np.frombuffer(s["ids"], f"<u{got.id_bytes}"), 0
        assert len(ids) == s["n_tokens"] == at[s["sequence_id"]] and len(s["doc_ids"]) == len(s["lengths"])
        for doc, n in zip(s["doc_ids"], s["lengths"]):
            part = ids[first : first + n].astype("<u4").tobytes()
            assert any(r["ids_crc32"] == zlib.crc32(part) for r in rows if (r["doc_id"], r["sequence_id"], r["offset"]) == (doc, s["sequence_id"], first))
            first += n
    none = packing.packed_documents(empty, WORDS, end_id=1)
    assert none.pieces.count() == 0 and packing.packed_sequences(none).count() == 0


def test_packing_of_a_table(spark):
    rows = queries.op13_best_fit_packing(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    total = defaultdict(int)
    for r in rows:
        total[r["doc_id"]] += r["length"]
    assert total == {i: len(whole_ids(t)) for i, t in docs.items()}
    sequences = len({r["sequence_id"] for r in rows})
    assert sequences <= lower_bound(Counter(r["length"] for r in rows), 4096) + 1
