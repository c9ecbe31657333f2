"""The training-data operators against brute force, round trips and held-out labels, on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from peakweave.llm import decontamination, embedding_dedup, language, line_dedup, packing, quality, sharding, simhash, url_filter, warc
from peakweave.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tile int, h string"
VOCABULARY = ["river", "stone", "garden", "letter", "window", "music", "table", "forest", "winter", "silver", "Über", "été", "niño"]


def _docs(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "x") for i, t in rows], DOCS)


def _text(rng, n):
    return " ".join(rng.choice(VOCABULARY) + str(rng.randrange(40)) * (rng.random() < 0.3) for _ in range(n))


def _odd(rng):
    """Nulls, empty, blank, one word, repeats, ties, a long text, copies of a text."""
    base = _text(rng, 60)
    rows = [(1, None), (2, ""), (3, "  \t\n "), (4, "word"), (5, base), (6, base), (7, base), (8, base.upper()), (9, base + " more"), (10, _text(rng, 9000)), (11, "a b"), (12, "a b")]
    return rows + [(20 + k, _text(rng, rng.randrange(3, 80))) for k in range(25)]


def _reachable(ids, linked):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(5, 5), (None, 3), (100, 101), (100, 101)] + [(200 + k, 201 + k) for k in range(20)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()))
    own = {(a, b) for a, b in links if a is not None and a != b}
    ids = sorted({x for e in own for x in e})
    want = _reachable(ids, lambda a, b: (a, b) in own or (b, a) in own)
    assert {i: got.get(i, i) for i in ids} == want
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def _fingerprint(text):
    """The definition, bit by bit."""
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark):
    rows = _odd(random.Random(2)) + [(6, "second row of an id")]
    got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(_docs(spark, rows)).collect()]
    assert sorted((i, f) for i, f, _ in got) == sorted((i, _fingerprint(t)) for i, t in rows)
    reps = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        reps.setdefault(_fingerprint(t), i)
    prints_of = {}
    for f, i in reps.items():
        prints_of.setdefault(i, []).append(f)
    assert len(reps) >= 20
    want = _reachable(sorted(prints_of), lambda a, b: any((x ^ y).bit_count() <= 3 for x in prints_of[a] for y in prints_of[b]))
    assert {(i, f): c for i, f, c in got} == {(i, f): want[reps[f]] for i, t in rows for f in [_fingerprint(t)]}
    assert simhash.near_duplicates(_docs(spark, [])).count() == 0


def test_simhash_finds_every_pair_within_the_radius_however_hot_a_bucket():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, dtype=np.int64)
    prints = np.unique(np.array([base ^ np.bitwise_xor.reduce(np.int64(1) << rng.integers(0, 30, 2)) for _ in range(300)], np.int64))
    table = pa.table({"tile": np.zeros(len(prints), np.int64), "rep": np.arange(len(prints)), "fp": prints})
    found = simhash._close(3)(table).to_pylist()
    want = _reachable(range(len(prints)), lambda a, b: (int(prints[a]) ^ int(prints[b])).bit_count() <= 3)
    linked = {(r["a"], r["b"]) for r in found}
    assert _reachable(range(len(prints)), lambda a, b: (a, b) in linked or (b, a) in linked) == want and len(linked) < len(prints)


def test_one_of_each_keeps_clean_documents_and_one_copy(spark):
    rng = random.Random(4)
    base = _text(rng, 300)
    words = base.split()
    near = [" ".join(words[:k] + ["inserted"] + words[k:]) for k in (50, 120, 200)]
    rows = [(1, base), (2, base)] + [(3 + k, t) for k, t in enumerate(near)] + [(50 + k, _text(random.Random(k), 200)) for k in range(20)] + [(None, base), (1, base)]
    kept = simhash.one_of_each(_docs(spark, rows))
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == [-1, 1, 1, *range(50, 70)]
    assert set(kept.columns) == set(_docs(spark, []).columns)


def _similarity(a, b):
    """Of two texts, repeated shingles aside; texts without a word are alike."""
    x, y = (set(_shingles((t or "").encode().lower().split())) for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


def test_one_of_each_tells_rows_of_an_id_apart(spark):
    a, b = _text(random.Random(40), 80), _text(random.Random(41), 80)
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b + " more"), (4, None), (5, " "), (None, a)]
    kept = simhash.one_of_each(_docs(spark, rows).withColumn("__pw_x", F.lit(1)).withColumn("component_id", F.lit(2)).withColumn("row", F.lit(3)))
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(1, a), (2, b), (2, b), (4, None), (None, a)]))
    assert simhash.one_of_each(_docs(spark, [])).count() == 0


def test_one_of_each_takes_close_fingerprints_and_verifies_them(spark, monkeypatch):
    """Without a shared rare shingle to go by, copies are found by the blocks of their fingerprints; close ones that aren't similar stay."""
    rows, spam = [], "again " * 400
    for k in range(30):
        base = _text(random.Random(60 + k), 300)
        rows += [(2 * k, base), (2 * k + 1, base + " more")]
    rows += [(100 + k, spam + _text(random.Random(k), 60)) for k in range(3)]
    apart = {i: (_fingerprint(dict(rows)[i]) ^ _fingerprint(dict(rows)[i + 1])).bit_count() for i in range(0, 60, 2)}
    assert _fingerprint(rows[-1][1]) == _fingerprint(rows[-2][1]) and sum(0 < d <= 3 for d in apart.values()) > 10
    monkeypatch.setattr(simhash, "_prefix_keys", lambda texts, reps, *how: reps.selectExpr("own", "own AS key").limit(0))
    kept = sorted(r.doc_id for r in simhash.one_of_each(_docs(spark, rows)).collect())
    assert kept == sorted([*apart, *(i + 1 for i, d in apart.items() if d > 3), 100, 101, 102])


def _similar_equal_brute_force(spark, rows):
    got = {(r.doc_id, r.component_id) for r in simhash.similar_documents(_docs(spark, rows)).collect()}
    texts = dict(rows)
    want = _reachable(sorted(texts), lambda a, b: _similarity(texts[a], texts[b]) >= 0.8)
    assert got == set(want.items())
    return want


def test_similar_short_texts_equal_brute_force(spark):
    rng = random.Random(14)
    rows = _odd(random.Random(15))
    for k in range(120):
        words = [f"w{rng.randrange(5000)}" for _ in range(5 + k % 16)]
        rows += [(1000 + 3 * k, " ".join(words)), (1001 + 3 * k, " ".join([*words, "more"])), (1002 + 3 * k, " ".join([*words[:-1], "changed"]))]
    want = _similar_equal_brute_force(spark, rows)
    assert sum(i != c for i, c in want.items()) > 150


def test_similar_long_texts_equal_brute_force_in_hot_buckets(spark):
    rng = random.Random(16)
    opening, rows = [f"o{k}" for k in range(30)], []
    for k in range(8):
        base = [f"w{rng.randrange(5000)}" for _ in range(150)]
        for changed in (0, 1, 3, 5, 6, 8, 10, 12, 14):  # similarities from 1 to below 0.5
            own = list(base)
            for at in rng.sample(range(150), changed):
                own[at] = f"c{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(opening + own)))
    want = _similar_equal_brute_force(spark, rows)
    texts = dict(rows)
    middling = [(a, b) for a in texts for b in texts if a < b and 0.6 <= _similarity(texts[a], texts[b]) < 0.8]
    assert len(rows) > simhash._SMALL and len(middling) > 20 and 8 < len(set(want.values())) < len(rows)


@pytest.mark.parametrize("n", [120, 700])
def test_similar_families_equal_brute_force(spark, n):
    """More sets than a bucket compares pair by pair, of one base and on both sides of the threshold; sketches hold the short ones whole."""
    rng = random.Random(n)
    base, rows = [f"w{rng.randrange(5000)}" for _ in range(n)], []
    for k in range(simhash.COMMON + 30):
        own = list(base)
        for at in rng.sample(range(n), rng.randrange(n // 120, n // 40 + 1)):
            own[at] = f"c{rng.randrange(5000)}"
        rows.append((k, " ".join(own)))
    rows += [(500 + k, f"{' '.join(base[:40])} {_text(random.Random(k), 60)}") for k in range(simhash.COMMON + 6)]  # a passage that many share
    want = _similar_equal_brute_force(spark, rows)
    assert 2 < sum(c == i for i, c in want.items() if i < 500) < simhash.COMMON


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 16))
    rows = [(k, [float(x) for x in np.float32(base[k % 12] + 0.03 * rng.normal(size=16))], int(k % 3)) for k in range(120)]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [1.0, None] * 8, 0), (203, [float("nan")] * 16, 0), (204, [float("inf")] + [1.0] * 15, 0), (205, [], 0), (206, rows[0][1], None), (207, rows[0][1], 0), (208, rows[0][1][:8], 0), (0, rows[0][1], 0)]
    got = [tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()]
    usable = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]

    def cosine(a, b):
        return float(a @ b / np.sqrt((a @ a) * (b @ b)))

    links = {(p, q) for p, (_, v, x) in enumerate(usable) for q, (_, w, y) in enumerate(usable) if p != q and x == y and len(v) == len(w) and cosine(v, w) >= 0.98}
    comp = _reachable(range(len(usable)), lambda a, b: (a, b) in links)
    least = {}
    for p, c in comp.items():
        least[c] = min(least.get(c, usable[p][0]), usable[p][0])
    want = [(i, sum(q == p for q, _ in links), least[comp[p]], i == least[comp[p]]) for p, (i, _, _) in enumerate(usable)]
    want += [(i, 0, i, True) for i in (200, 201, 202, 203, 204, 205, 206)]
    assert sorted(got) == sorted(want) and len(links) > 100
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_hadamard_is_orthogonal():
    h = embedding_dedup.hadamard(np.eye(8))
    assert np.allclose(h @ h.T, 8 * np.eye(8))


def _best_shards(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, n, held = (low + high) // 2, 1, 0
        for s in sizes:
            if held + s > middle:
                n, held = n + 1, 0
            held += s
        low, high = (low, middle) if n <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("n", [0, 3, 400])
def test_shards_are_minimax_gapless_and_atomic(spark, n):
    rng = random.Random(n)
    rows = (_odd(rng) + [(1000 + k, _text(rng, rng.randrange(1, 30))) for k in range(n)])[: n if n < 10 else None]
    rows += rows[:2]
    got = sharding.minimax_shards(_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    if not rows:
        return
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t or "")
    weights, shard_of = Counter(), {}
    for r in got:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        assert shard_of.setdefault(data, r.shard) == r.shard
        weights[hashlib.sha256(data).hexdigest()] += r.size
    per = {}
    for r in got:
        per.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in per.values())
    assert max(sum(r.size for r in rs) for rs in per.values()) == _best_shards([weights[k] for k in sorted(weights)], 8)


def test_packing_round_trip(spark):
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    rows = _odd(random.Random(6)) + [(90, "a <|endoftext|> b"), (91, "x" * 5000), (92, "　﻿ 你好 🙂\r\n\r\n   ")]
    plain = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    ids = {i: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in rows}
    done, sequences = Counter(), {}
    for r in sorted(packing.packed(_docs(spark, rows)).collect(), key=lambda r: (r.doc_id, r.start)):
        own = ids[r.doc_id]
        assert r.start == done[r.doc_id] and r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        done[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert done == {i: len(v) for i, v in ids.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.packed(_docs(spark, [])).count() == 0


def test_differencing_levels_and_rises():
    rng = random.Random(7)
    for _ in range(30):
        sizes = [rng.randrange(1, 300) for _ in range(rng.randrange(1, 200))]
        found = packing.pack(sizes, 1024)
        sums = [sum(sizes[i] for i in w) for w in found]
        assert sorted(i for w in found for i in w) == list(range(len(sizes))) and max(sums) <= 1024
        assert len(found) <= -(-sum(sizes) // 1024) * 1.35 + 1
    even = packing.differencing([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in even) == [14, 16]  # the textbook case of differencing


def _multiway(sizes, windows):
    """Karmarkar-Karp as it is told: tuples of sums, the two of the widest spread merged in opposite order."""
    parts = [(tuple([(n, [i])] + [(0, [])] * (windows - 1)), k) for k, (i, n) in enumerate(enumerate(sizes))]
    for count in range(len(sizes), 2 * len(sizes) - 1):
        parts.sort(key=lambda p: (p[0][-1][0] - p[0][0][0], p[1]))
        (a, _), (b, _) = parts[:2]
        both = sorted(((x + y, m + n) for (x, m), (y, n) in zip(a, reversed(b), strict=True)), key=lambda w: -w[0])
        parts = [*parts[2:], (tuple((s - both[-1][0], m) for s, m in both), count)]
    return [m for _, m in parts[0][0]]


def test_differencing_equals_the_plain_method():
    rng = random.Random(35)
    for _ in range(200):
        sizes = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 25))]
        for windows in (1, 2, 3, 7):
            spread = lambda found: sorted(sum(sizes[i] for i in w) for w in found if w)
            assert spread(packing.differencing(sizes, windows)) == spread(_multiway(sizes, windows)), (sizes, windows)


def test_repeated_rows_are_packed_and_numbered_apart(spark):
    pytest.importorskip("public_tokenizers")
    rows = [(7, "the same words again")] * 3000 + [(None, None)] * 500 + [(8, "")] * 500
    got = packing.packed(_docs(spark, rows), group_tokens=2048).collect()
    sizes = Counter(r.sequence_id >> 24 for r in got)
    assert max(sizes.values()) < 4 * len(got) / len(sizes) and sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
    shards = sharding.minimax_shards(_docs(spark, rows)).collect()
    assert all(sorted(r.slot for r in shards if r.shard == k) == list(range(sum(r.shard == k for r in shards))) for k in range(8))


def _shingles(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [("whole", *words)] if words else []


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(8)
    items = [(k, _text(rng, n)) for k, n in enumerate((14, 25, 40, 59, 25, 3))] + [(10, None), (11, "  "), (12, "same same same same same same same")]
    filler = lambda n: _text(random.Random(n), n)
    edited = items[3][1].split()
    edited[2] = "changed"
    rows = _odd(rng) + [(100 + k, f"{filler(20 + k)}\n{(t or '').upper()}  {filler(9)}") for k, (_, t) in enumerate(items)]
    long = [f"w{rng.randrange(900)}" for _ in range(104)]
    items.append((20, " ".join(long)))
    swapped = " ".join([filler(30), *long[52:], *long[:52], filler(31)])  # a window of similarity 0.92 that begins in no run of the item's shingles
    spread = [*long[:2], "changed", *long[3:40], "put", "in", *long[40:70], "more", *long[70:]]
    rows += [(300, swapped), (300, filler(25)), (301, " ".join(spread)), (302, " ".join(long[60:])), (303, f"{filler(12)} {' '.join(long[:100])}")]
    rows += [(200, items[3][1]), (201, " ".join(edited)), (202, items[2][1] + " " + items[1][1]), (203, items[5][1]), (204, "x " + items[5][1]), (205, "same " * 40), (200, items[3][1]), (None, items[0][1])]
    got = {(r.doc_id, r.contaminated, r.n_items) for r in decontamination.contamination(_docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    verdicts = []
    for i, t in rows:
        s, hits = _shingles((t or "").lower().split()), set()
        for k, item in items:
            mine = Counter(_shingles((item or "").lower().split()))
            m = sum(mine.values())
            for at in range(max(1, len(s) - m + 1)) if m and s else ():
                a = Counter(s[at : at + m])
                same = sum((a & mine).values())
                if same / (sum(a.values()) + m - same) >= 0.8:
                    hits.add(k)
        verdicts.append((i, bool(hits), len(hits)))
    want = set(verdicts)
    assert got == want
    assert (300, True, 1) in want and (300, False, 0) in want and (302, False, 0) in want
    clash = _docs(spark, rows).selectExpr("*", "1 AS _gone", "2 AS row", "3 AS start", "4 AS item_id", "5 AS words")
    clean = decontamination.clean_documents(clash, spark.createDataFrame(items, "item_id long, text string"))
    bad = {(r[0], t) for r, t in zip(verdicts, (t for _, t in rows), strict=True) if r[1]}
    assert clean.columns == clash.columns and sorted(str((r.doc_id, r.text)) for r in clean.collect()) == sorted(str(x) for x in rows if x not in bad)
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontamination.contamination(_docs(spark, rows), none).collect())
    assert decontamination.contamination(_docs(spark, []), none).count() == 0


def test_line_templates(spark):
    note, licence = "posted by user {} at {} in the forum", "All rights reserved by the owners of this text."
    rows = [(k, f"{_text(random.Random(k), 30)}\n{note.format(f'n{k}', f'{k}:00')}\n{licence if k % 2 else _text(random.Random(99 + k), 8)}\nyes\n\n1 2 3 {k}") for k in range(8)]
    rows += [(20, None), (21, ""), (22, licence), (22, licence), (None, licence), (23, "\n\n")]
    got = {r.doc_id: r for r in line_dedup.line_report(_docs(spark, rows)).collect()}
    for k in range(8):
        lines = rows[k][1].split("\n")
        gone = ({1} if k > 0 else set()) | ({2} if k % 2 and k > 1 else set())
        assert got[k].text == "\n".join(x for i, x in enumerate(lines) if i not in gone), k
        assert (got[k].n_lines, got[k].n_dropped) == (6, len(gone))
    assert (got[20].text, got[20].n_lines) == (None, 0) and got[21].text == "" and got[22].text == "" and got[None].text == licence and got[23].text == "\n\n"
    assert line_dedup.without_recurring(_docs(spark, rows)).columns == _docs(spark, []).columns
    assert line_dedup.line_report(_docs(spark, [])).count() == 0


def test_repeated_rows_change_no_line(spark):
    shared = [(1, "p q r a b c d e f g 1"), (2, "p q r a b c d e f g 2"), (3, "p q r a b c d e f g 3"), (4, "p q r k l m n o s t 4"), (5, "p q r k l m n o s t 5")]
    table = "12 13 14 15 total of 16 17"  # more fields than a template may have: it recurs word for word only
    rows = shared + [(10 + k, f"{table}\n{21 + k} 22 23 24 total of 25 26\n{'abcd'[k]}{k} 1 2 3 of their own") for k in range(4)]
    once = {(r.doc_id, r.text, r.n_dropped) for r in line_dedup.line_report(_docs(spark, rows)).collect()}
    assert {i: n for i, _, n in once} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 10: 0, 11: 1, 12: 1, 13: 1}
    twice = line_dedup.line_report(_docs(spark, rows + rows)).collect()
    assert len(twice) == 2 * len(rows) and {(r.doc_id, r.text, r.n_dropped) for r in twice} == once
    again = [(2, "a text of its own\nin two lines here"), (3, "a text of its own\nand another line here")]  # further texts of known ids
    got = {(r.doc_id, r.text) for r in line_dedup.line_report(_docs(spark, rows + again)).collect()}
    assert got == {(i, t) for i, t, _ in once} | set(again)
    clash = _docs(spark, rows).selectExpr("*", "1 AS row", "2 AS pos", "3 AS line", "4 AS leaf", "5 AS first_doc")
    assert {(r.doc_id, r.text) for r in line_dedup.without_recurring(clash).collect()} == {(i, t) for i, t, _ in once}


def test_quality_tells_junk_on_held_out_documents(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(300):
        text = _text(rng, 60)
        good = k % 4 != 0
        rows.append((k, text if good else re.sub(r"(\w+)", r"\1***", text) if k % 8 else " ".join(w for w in text.split() for _ in range(6))))
        labels.append((k, int(good), 0))
    rows += [(900, None), (901, ""), (902, "x"), (None, "y")]
    labels += [(5, None, 0), (None, 1, 0), (7, 3, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.scored(_docs(spark, rows), table).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [(k, q) for k, q, _ in labels[:300] if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out for k, _ in held) and sum(got[k].predicted == q for k, q in held) >= 0.95 * len(held)
    kept = quality.good_documents(_docs(spark, rows), table)
    assert kept.columns == _docs(spark, []).columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.predicted}
    alone = quality.scored(_docs(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in alone.collect()} == {0.5}


def test_vote_equals_brute_force():
    rng = np.random.default_rng(31)
    terms = np.abs(rng.normal(size=(60, 40))).astype(np.float32)
    terms[7] = terms[3]  # an even place, with the other label
    model = quality.fit(terms, np.arange(60) % 2, rank=8)
    asked = np.concatenate((np.abs(rng.normal(size=(30, 40))), terms[:10], np.zeros((1, 40)))).astype(np.float32)
    for k in (1, 5, 15, 100):
        for x, got in zip(asked, quality.vote(model, asked, k), strict=True):
            v = quality._unit(((x * model["weights"]) @ model["basis"])[None])[0]
            near = sorted(((float(v @ y), -i) for i, y in enumerate(model["vectors"])), reverse=True)[:k]
            total = sum(max(0, c) for c, _ in near)
            want = sum(max(0, c) * (i % 2) for c, i in near) / total if total > 1e-9 else model["prior"]
            assert abs(got - want) < 1e-4, (k, got, want)


def test_repeated_labelled_rows_teach_once(spark):
    rng = random.Random(32)
    rows = [(k, _text(rng, 40) if k % 2 else "$$$ " * (k + 1)) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    once = {r.doc_id: r.score for r in quality.scored(_docs(spark, rows), labels).collect()}
    more = _docs(spark, rows + [r for r in rows if r[0] < 20 for _ in range(30)]).selectExpr("*", "1 AS quality", "2 AS terms", "3 AS score")
    got = quality.scored(more, labels).collect()
    assert len(got) == 660 and all(abs(r.score - once[r.doc_id]) < 1e-6 for r in got)


def test_decisions_equal_brute_force():
    rng = np.random.default_rng(33)
    x = rng.normal(size=(50, 6)).astype(np.float32)
    names = ["a", "b", "c", "d"]
    for n in (1, 2, 3, 4):
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
        duels, alone = (rng.normal(size=(k, 6)).astype(np.float32) for k in (len(pairs), n))
        best, share = language.decide(names[:n], duels, x)
        widest, sure = language.widest(names[:n], alone, x)
        for i, v in enumerate(x):
            margins = [float(np.clip(v @ m, -6, 6)) for m in duels]
            wins, sums = [0] * n, [0.0] * n
            for (a, b), m in zip(pairs, margins, strict=True):
                wins[a if m >= 0 else b] += 1
                sums[a] += m
                sums[b] -= m
            assert best[i] == max(range(n), key=lambda c: (wins[c], sums[c])) and 0 <= share[i] <= 1
            assert n == 1 or widest[i] == max(range(n), key=lambda c: float(v @ alone[c]))
            assert 1 / n - 1e-6 <= sure[i] <= 1


def test_machine_separates_and_rests_at_a_minimum():
    rng = np.random.default_rng(34)
    y = np.repeat([1, -1], 40).astype(np.float32)
    x = np.concatenate((rng.normal(size=(80, 3)) * 0.2 + y[:, None] * 0.4, np.ones((80, 1))), axis=1).astype(np.float32)
    loss = lambda w: 0.5e-4 * float(w @ w) + float((np.maximum(0, 1 - y * (x @ w)) ** 2).mean())
    w = language.svm(x, y, steps=2000)
    assert (np.sign(x @ w) == y).mean() > 0.95
    assert all(loss(w) <= loss(w + d.astype(np.float32)) + 1e-5 for d in rng.normal(size=(200, 4)) * 0.05)


def test_languages_of_odd_tables(spark):
    schema = "doc_id long, text string, lang string, quality int, score double"
    assert language.identified(spark.createDataFrame([], schema)).count() == 0
    rows = [(k, ("the and of with " if k % 2 else "der und die das ") * 8, "en" if k % 2 else "de", 1, 0.5) for k in range(40)]
    rows += [(1, "the and of with", "en", 1, 0.5)] * 300 + [(50, "the and of with " * 30_000, None, 1, 0.5), (None, "der und die", "de", 1, 0.5)]
    got = language.identified(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.lang_pred) for r in got if r.doc_id in (1, 2, 50)} == {(1, "en"), (2, "de"), (50, "en")}
    one = language.identified(spark.createDataFrame([(1, "some words", "xx", 1, 0.5), (2, "12", "xx", 1, 0.5)], schema)).collect()
    assert {(r.doc_id, r.lang_pred) for r in one} == {(1, "xx"), (2, "und")}


def test_language_is_told_on_held_out_documents(spark):
    words = {"en": "the and of that with which this from have been", "de": "der und die das nicht mit sich eine auch wird", "fr": "le et les des une dans pour qui est avec", "es": "el los las una por con que para del como", "fi": "ja on ei se hän mutta kun niin että kuin"}
    rng = random.Random(10)
    rows = [(k, " ".join(rng.choice(words[lang].split()) for _ in range(30)), lang) for k, lang in enumerate(list(words) * 40)]
    rows += [(900, None, "en"), (901, "123 ... !", "en"), (902, "", None), (903, "the and of", None)]
    got = {r.doc_id: r for r in language.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "en"
    held = [(i, lang) for i, _, lang in rows[:200] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i, _ in held) and sum(got[i].lang_pred == lang for i, lang in held) >= 0.97 * len(held)
    nothing = language.identified(spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")).first()
    assert (nothing.lang_pred, nothing.score) == ("und", 0.0)


URLS = [None, "", "no scheme/en/", "http://COM/en/x", "https://a.b.example.com/en/7?x#y", "http://example.com/en/8", "ftp://x.example.net/de/81", "http://x.net/de", "http://net?de/", "http://badexample.com/en", "http://notcom/en/", "http://a.org#/es/", "http://a.org/es/é"]


def test_url_rules(spark):
    got = {r.page_id: r for r in url_filter.judged(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string"), url_filter.train_rows(url_filter.seed_urls(400))).collect()}
    for i, url in enumerate(URLS):
        host, path = url_filter.split_url(url)
        own = max(((r, v) for r, v in url_filter.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])), key=lambda x: len(x[0]), default=(None, None))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, own[0]) and got[i].verdict in ("allow", "block") and (own[1] is None or got[i].verdict == own[1])


def test_url_trees_on_held_out_urls():
    rows = url_filter.seed_urls(3000)
    model, held = url_filter.train_rows(rows[:2000]), rows[2000:]
    said = url_filter.score(model["trees"], url_filter.features([u for u, _ in held], model["rates"])) >= 0.5
    assert (said == np.array([b for _, b in held], bool)).mean() > 0.95


def test_url_trees_on_held_out_words_and_shapes():
    rows = url_filter.seed_urls(4000)
    x, y = url_filter.features([u for u, _ in rows], {}), np.array([b for _, b in rows], bool)
    for f in (3, 7, 8, 11):  # depth, digits and hyphens of the host, parameters: in both classes
        assert (x[y, f] > x[:, f].min()).any() and (x[~y, f] > x[:, f].min()).any() and x[~y, f].max() > np.median(x[y, f])
    model = url_filter.train_rows(rows)
    assert len({f for splits, _ in model["trees"]["trees"] for f, t in splits if np.isfinite(t)}) >= 6
    held = url_filter.seed_urls(1000, 2, ("chan", "zu", "plo", "ei", "gart", "mo"), ("{w}.{w}", "{d}-{w}", "{w}~", "v{d}"))
    said = url_filter.score(model["trees"], url_filter.features([u for u, _ in held], model["rates"])) >= 0.5
    assert (said == np.array([b for _, b in held], bool)).mean() > 0.9


def test_one_boosting_step_is_the_best_there_is():
    rng = np.random.default_rng(36)
    x, y = rng.integers(0, 6, (80, 3)).astype(float), rng.integers(0, 2, 80).astype(float)
    model = url_filter.boost(x, y, trees=1, depth=1)
    prior = y.mean()
    gain = lambda own: (prior - y[own]).sum() ** 2 / (own.sum() * prior * (1 - prior) + 1)
    best = max((gain(x[:, f] <= t) + gain(x[:, f] > t), -f, -t) for f in range(3) for t in range(5))
    (splits, leaves), f, t = model["trees"][0], *model["trees"][0][0][0]
    assert abs(gain(x[:, f] <= t) + gain(x[:, f] > t) - best[0]) < 1e-9
    for side, leaf in ((x[:, f] <= t, leaves[0]), (x[:, f] > t, leaves[1])):
        assert abs(leaf - 0.2 * (y[side] - prior).sum() / (side.sum() * prior * (1 - prior) + 1)) < 1e-9
    assert np.allclose(url_filter.score(model, x), 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + np.where(x[:, f] > t, leaves[1], leaves[0])))))


def test_url_verdicts_of_odd_tables(spark):
    labelled = spark.createDataFrame([(u, b) for u, b in url_filter.seed_urls(300)] + [(None, 1), ("http://x.y/", None)], "url string, blocked int")
    model = url_filter.train(labelled, bound=250)
    schema = "page_id long, url string, score double, host string, rule string"
    assert url_filter.judged(spark.createDataFrame([], schema), model).count() == 0
    rows = [(k % 7, u, 1.0, "h", "r") for k, u in enumerate(URLS * 3)] + [(None, "http://z.biz/" + "a/" * 50_000, 0.0, None, None)]
    got = url_filter.judged(spark.createDataFrame(rows, schema), model).collect()
    assert len(got) == len(rows) and len({(r.host, r.path, r.rule, r.verdict, r.score) for r in got}) <= len(set(URLS)) + 1


def test_loser_tree_merges_any_runs():
    rng = random.Random(11)
    for k in range(0, 9):
        found = [sorted((rng.randrange(30), j) for j in range(rng.randrange(0, 12))) for _ in range(k)]
        assert list(warc.LoserTree(found)) == sorted(x for r in found for x in r)


def test_archives_round_trip_in_one_order(spark, tmp_path):
    rng = random.Random(12)
    big = "<p>" + "é" * 80 + "</p>"
    rows = [(k, rng.choice(["http://b.example.org/x", "https://www.a.example.org/", None]), rng.choice([big, big + str(k % 3), "small", "", None])) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    index, _ = warc.archive(pages, folder=f"file://{tmp_path}/w")
    got = {r.page_id: r for r in warc.read_archives(index).collect()}
    first = {}
    for k, _, html in rows:
        first.setdefault(html or "", k)
    for k, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= 100 and first[html] != k
        assert tuple(got[k]) == (k, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[html] if again else None)
    order = [(r.key, r.timestamp, r.page_id) for r in index.orderBy("range_id", "position").collect()]
    assert order == sorted(order) and len(order) == 60
    odd = [(10**15, "http://c.example.org/", big, 3), (-7, None, big, None), (-7, None, big, None), (-(1 << 63), "http://d.example.org/", "x" * 200, 1 << 62), ((1 << 63) - 1, "", "x" * 200, -5), (None, "", big, 9)]
    table = spark.createDataFrame([(*r[:3], r[3], "f", "d", 1) for r in odd], "page_id long, url string, html string, seen long, first string, digest string, n int")
    for time_col in (None, "seen"):
        index, _ = warc.archive(table.repartition(3), time_col=time_col, folder=f"file://{tmp_path}/{time_col}")
        kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.read_archives(index).collect())
        assert kinds == sorted([(str(10**15), "revisit", -7), ("-7", "response", None), ("-7", "response", None), (str(-(1 << 63)), "response", None), (str((1 << 63) - 1), "revisit", -(1 << 63)), ("None", "revisit", -7)])
        if time_col:
            assert sorted(r.timestamp for r in index.collect()) == sorted(r[3] or 0 for r in odd)
    none, _ = warc.archive(pages.where("page_id < 0"), folder=f"file://{tmp_path}/e")
    assert none.count() == 0 and warc.read_archives(none).count() == 0


def test_short_archives_are_merged_in_ranges(spark, tmp_path):
    pages = spark.range(20_000).selectExpr("id AS page_id", "concat('http://h', id % 977, '.example.org/', id) AS url", "'x' AS html").repartition(6)
    index, _ = warc.archive(pages, folder=f"file://{tmp_path}/r")
    sizes = [r["count"] for r in index.groupBy("range_id").count().collect()]
    order = [(r.key, r.timestamp, r.page_id) for r in index.orderBy("range_id", "position").collect()]
    assert len(sizes) == 4 and max(sizes) < 10_000 and order == sorted(order) and len(order) == 20_000


def test_many_runs_merge_in_passes_and_ranges(spark, tmp_path):
    rng = random.Random(13)
    runs, rows = [], []
    for k in range(11):
        own = sorted(warc._order((rng.choice("abc"), rng.randrange(9), rng.choice([None, rng.randrange(99)]), "f", j, k)) for j in range(40))
        warc.write_run(f"file://{tmp_path}/{k}.index", own)
        runs.append(warc._manifest(f"file://{tmp_path}/{k}.index", own, 5))
        rows += own
    index = warc.merged_index(spark, runs, f"file://{tmp_path}/m", fan_in=3, range_rows=60)
    got = [tuple(r)[2:] for r in index.orderBy("range_id", "position").collect()]
    assert got == [warc._unordered(r) for r in sorted(rows)] and index.select(F.countDistinct("range_id")).first()[0] > 4
