import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import jaccard, line_dedup, media, mixing, passages, url_filter, webp

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def corpus(seed=5):
    """Texts with copies, near copies, shared passages, and the odd cases."""
    r = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in r.zipf(1.3, n) % 3000]
    rows, passage = [], word(60)
    for k in range(60):
        rows.append((k, " ".join(word(int(r.integers(3, 150))))))
    for k in range(60, 90):  # near copies of one text, a hot group
        w = rows[7][1].split() + word(100)[:0]
        w = w * 2
        w[int(r.integers(len(w)))] = f"edit{k}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, rows[3][1]) for k in range(20)]  # exact copies
    rows += [(200 + k, " ".join(word(30) + passage + word(25))) for k in range(15)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "one"), (304, "One"), (305, "a b c d"), (306, "a b c d e"), (306, "a b c d e"), (None, rows[5][1]), (307, " ".join(word(20_000))), (308, "x " * 90)]
    return rows


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return sorted(((d, len(sets[k]), least.get(find(k)) if sets[k] else d) for k, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("few", [64, 3])
def test_components_equal_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard, "FEW", few)
    rows = corpus()
    df = frame(spark, rows).withColumn("x", F.lit("clash")).withColumn("c", F.lit(1))
    assert sorted(map(tuple, jaccard.components(df).collect()), key=repr) == brute_components(rows)


def bridge_groups(groups=6, copies=25, seed=11):
    """Groups of near copies of two texts, which only shortened copies of both link with one another."""
    r, rows = np.random.default_rng(seed), []
    for g in range(groups):
        base, a, b = ([f"{c}{g}_{k}" for k in range(n)] for c, n in (("o", 84), ("a", 20), ("b", 20)))
        texts = [base + x[:12] for x in (a, b)] + [base + x + [f"own{g}_{c}_{k}"] for c, x in enumerate((a, b)) for k in range(copies)]
        rows += [" ".join(x) for x in texts]
    return [(int(k), x) for k, x in zip(r.permutation(len(rows)), rows, strict=True)]


@pytest.mark.parametrize("few", [64, 3])
def test_components_with_bridges_equal_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard, "FEW", few)
    rows = bridge_groups()
    want = brute_components(rows)
    assert len({c for _, _, c in want}) == 6
    assert sorted(map(tuple, jaccard.components(frame(spark, rows)).collect()), key=repr) == want


def test_components_of_nested_texts_equal_all_pairs(spark):
    r = np.random.default_rng(3)
    rows = [" ".join(f"n{g}_{k}" for k in range(n)) for g in range(1000) for n in (49, 64, 84, 104)]
    rows = [(int(k), x) for k, x in zip(r.permutation(len(rows)), rows, strict=True)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.components(frame(spark, rows)).collect()}
    groups = {}
    for d, x in rows:
        groups.setdefault(x.split("_")[0], []).append((d, x))
    want = {d: (n, c) for group in groups.values() for d, n, c in brute_components(group)}
    assert got == want


def test_components_of_edited_families_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", 5)
    r, rows = np.random.default_rng(12), []
    for g in range(4):
        family = [[f"f{g}_{k}" for k in range(120)]]
        for _ in range(120):
            w = list(family[int(r.integers(len(family)))])
            for _ in range(int(r.integers(1, 5))):
                k = int(r.integers(len(w)))
                if (kind := r.random()) < 0.4:
                    w[k] = f"e{r.integers(10**9)}"
                elif kind < 0.7:
                    del w[k : k + int(r.integers(1, 6))]
                else:
                    w.insert(k, f"i{r.integers(10**9)}")
            family.append(w)
        rows += [" ".join(x) for x in family]
    rows = [(int(k), x) for k, x in zip(r.permutation(len(rows)), rows, strict=True)]
    want = brute_components(rows)
    assert len({c for _, _, c in want}) > 8
    assert sorted(map(tuple, jaccard.components(frame(spark, rows)).collect()), key=repr) == want


def test_components_of_no_rows(spark):
    assert jaccard.components(frame(spark, [])).count() == 0


def brute_spans(rows, least=passages.LEAST):
    at = {}
    texts = {(d, t): WORD.findall((t or "").lower()) for d, t in rows}
    for key, w in texts.items():
        for k in range(len(w) - least + 1):
            at.setdefault(tuple(w[k : k + least]), []).append((key, k))
    out = {}
    for places in at.values():
        if len(places) > 1:
            for (d, t), k in places:
                out.setdefault(d, set()).update(range(k, k + least))
    return out


def test_repeated_passages(spark):
    rows = corpus()
    found = passages.repeated_passages(frame(spark, rows).withColumn("g", F.lit(1))).collect()
    got = {r.doc_id: {k for s in r.spans for k in range(s.start, s.end)} for r in found}
    want = brute_spans(rows)
    assert got.keys() == want.keys() and all(r.n_repeated == len(got[r.doc_id]) for r in found)
    assert got == want
    first = min(d for d, t in rows if d is not None and t == rows[3][1]) if len(rows[3][1].split()) >= 50 else None
    assert first is None or not [r for r in found if r.doc_id == first][0].later
    assert passages.repeated_passages(frame(spark, [])).count() == 0


def test_passages_around_a_frequent_sentence(spark):
    r = np.random.default_rng(4)
    word = lambda n: [f"v{x}" for x in r.integers(0, 10**6, n)]
    sentence, rows = word(40), []
    for _ in range(60):  # pairs that share ten words on either side of it, or the more on one side
        a = int(r.integers(0, 21))
        before, after = word(a), word(20 - a)
        rows += [word(30) + before + sentence + after + word(30) for _ in range(2)]
    rows += [word(40) + sentence + word(40) for _ in range(100)]
    rows += [word(40) + rows[0][20:50] + word(40) for _ in range(9)]  # parts that are too short
    rows = [(int(k), " ".join(x)) for k, x in zip(r.permutation(len(rows)), rows, strict=True)]
    found = passages.repeated_passages(frame(spark, rows)).collect()
    assert {x.doc_id: {k for s in x.spans for k in range(s.start, s.end)} for x in found} == brute_spans(rows)
    assert sum(not x.later for x in found) == 60 and all((x.later == x.spans) == (x.partner < x.doc_id) for x in found)


def test_passages_across_partitions_of_the_sort(spark):
    r = np.random.default_rng(7)
    word = lambda n: [f"v{x}" for x in r.integers(0, 10**6, n)]
    passage = word(52)
    rows = [(int(k), " ".join(word(20) + passage + word(9))) for k in r.permutation(300)] + [(500, " ".join(passage * 3)), (501, " ".join(passage)), (502, " ".join(passage))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    spark.conf.set("spark.sql.shuffle.partitions", 60)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = passages.repeated_passages(frame(spark, rows + rows[:1])).collect()
    finally:
        for name, value in (("execution.arrow.maxRecordsPerBatch", 10000), ("shuffle.partitions", 8), ("adaptive.coalescePartitions.enabled", "true")):
            spark.conf.set(f"spark.sql.{name}", value)
    got = {x.doc_id: {k for s in x.spans for k in range(s.start, s.end)} for x in found}
    assert got == brute_spans(rows) and len(found) == len(rows)
    least = min(d for d, _ in rows)
    assert all((x.later == x.spans) == (x.doc_id != least) for x in found if x.doc_id != 500)
    assert {x.partner for x in found if x.doc_id != least} == {least}


def test_minimisers():
    r = np.random.default_rng(0)
    for n, w in ((40, 31), (31, 31), (200, 5), (4, 5)):
        g = r.integers(0, 60, n).astype(np.uint64)
        assert passages.minimisers(g, w).tolist() == sorted({k for s in range(n - w + 1) for k in range(s, s + w) if g[k] == g[s : s + w].min()})


def test_line_dedup(spark):
    a, b = [f"line {k}" for k in range(12)], [f"other {k}" for k in range(12)]
    rows = [
        (1, "\n".join(a)),
        (2, "\n".join(b[:4] + a[3:9] + b[4:8])),  # a run in the middle goes
        (3, "\n".join(b[8:] + [f" {x} " for x in a[:2]])),  # two lines are too few
        (4, "\n".join(a)),  # a whole copy
        (5, None), (6, ""), (7, "single"), (None, "\n".join(a[6:10])),
        (8, "\n".join(["x y", "y z", "z x"] * 2)),  # repeats itself
    ]
    rows += [(100 + k, "\n".join([f"own {k} {j}" for j in range(4)] + ["license", "terms", "end"])) for k in range(40)]
    df = frame(spark, rows + rows[:1]).withColumn("n_lines", F.lit("clash")).withColumn("d", F.lit(1))
    out = line_dedup.dedup_lines(df)
    assert out.columns.count("n_lines") == 1 and "d" in out.columns
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in out.collect()}
    assert out.count() == len(rows) + 1
    assert got[1] == ("\n".join(a), 12, 0) and got[4] == ("", 12, 12) and got[None] == ("", 4, 4)
    assert got[2] == ("\n".join(b[:8]), 14, 6) and got[3][2] == 0 and got[7] == ("single", 1, 0)
    assert got[5] == (None, 0, 0) and got[6] == ("", 1, 0) and got[8] == ("x y\ny z\nz x", 6, 3)
    assert got[100][2] == 0 and all(got[100 + k] == ("\n".join(f"own {k} {j}" for j in range(4)), 7, 3) for k in range(1, 40))
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_with_frequent_lines(spark):
    r = np.random.default_rng(9)
    line = lambda: f"hot {r.integers(40)}" if r.random() < 0.5 else f"own {r.integers(10**9)}"
    docs = [[line() for _ in range(int(r.integers(4, 12)))] for _ in range(600)]
    for _ in range(60):  # planted runs
        run = [line() for _ in range(int(r.integers(3, 6)))]
        for k in r.integers(0, len(docs), 3):
            docs[k] = docs[k][:2] + run + docs[k][2:]
    seen, want = set(), {}
    for d, x in enumerate(docs):
        gone = set()
        for k in range(len(x) - 2):
            if tuple(x[k : k + 3]) in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(tuple(x[k : k + 3]))
        want[d] = "\n".join(y for k, y in enumerate(x) if k not in gone)
    got = line_dedup.dedup_lines(frame(spark, [(d, "\n".join(x)) for d, x in enumerate(docs)])).collect()
    assert {x.doc_id: x.text for x in got} == want


def test_line_dedup_of_short_runs(spark):
    long, half, other = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("l", 50), ("h", 25), ("o", 25)))
    rows = [
        (1, f"start\n{long}\nend"), (2, f"{long}\nrest"),  # one line of 50 words
        (3, f"{half}\n{other}\nx\ny"), (4, f"z\n{half}\n{other}"), (5, f"{half}\nq"), (6, f"{other}\n{half}"),  # two lines
        (7, "two\nlines"), (8, "two \nlines"), (9, "two\nlines\nthree"), (10, "two"), (11, long),  # whole documents
        (12, ""), (13, " "), (14, "\n"), (15, None), (16, "\n\n\n"), (None, "\n\n\n"),
    ]
    got = {x.doc_id: (x.text, x.n_removed) for x in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    gone = {2: ("rest", 1), 4: ("z", 2), 8: ("", 2), 11: ("", 1), 16: ("", 3), None: ("", 4)}
    assert got == {d: gone.get(d, (t, 0)) for d, t in rows}


def test_line_dedup_joins_alike_at_every_size(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(line_dedup, "stored", lambda df, stored=line_dedup.stored: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df))
    out = line_dedup.dedup_lines(frame(spark, [(k, "one\ntwo\nthree\nfour") for k in range(9)]))
    assert out.where("n_removed = 4").count() == 8
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("SortMergeJoin") for p in plans) >= 4 and not any("BroadcastHashJoin" in p for p in plans)


def test_line_dedup_of_long_texts(spark):
    lines = [f"line {k}" for k in range(60_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["first", *lines[100:50_000], "last"])), (3, "x" * 1_000_000)]
    got = {x.doc_id: (x.text, x.n_removed) for x in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("first\nlast", 49_900), 3: (rows[2][1], 0)}


def test_winnowing_guarantee():
    r = np.random.default_rng(1)
    for _ in range(50):
        run, w = r.integers(0, 1000, 5), 3
        x = np.concatenate((r.integers(0, 1000, r.integers(0, 9)), run, r.integers(0, 1000, 4)))
        y = np.concatenate((r.integers(0, 1000, r.integers(0, 9)), run, r.integers(0, 1000, 2)))
        sx, sy = len(x) - 9, len(y) - 7
        here = {k - sx for k in line_dedup.winnowed(x, w) if sx <= k < sx + 5} & {k - sy for k in line_dedup.winnowed(y, w) if sy <= k < sy + 5}
        assert here


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        rate = left / sum(w[s] for s in open_)
        over = {s for s in open_ if rate * w[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out | {s: rate * w[s] for s in open_}


def test_mix(spark):
    r = np.random.default_rng(6)
    rows = [(k, " ".join(["w"] * int(r.integers(0, 900))), [None, "b", "a", "é", "a", "a"][k % 6]) for k in range(300)]
    rows += [(1000, None, "a"), (1001, "", "zero"), (None, "some words", "b"), (1, "twice here", "b"), (1, "twice here", "b")]
    df = frame(spark, rows, "doc_id long, text string, source string").withColumn("s", F.lit("clash")).withColumn("row", F.lit(1))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    first, again = mixing.Mix(df).taken().collect(), mixing.Mix(df.repartition(3)).taken().collect()
    assert sorted(map(tuple, first), key=repr) == sorted(map(tuple, again), key=repr) and len(first) == len(rows)
    want, taken = brute_targets(sizes), Counter()
    for x in first:
        assert x.source_size == sizes[x.source] and x.taken <= 2 * x.size
        assert abs(x.target - want[x.source]) < 1e-6
        taken[x.source] += x.taken
    assert all(abs(taken[s] - want[s]) <= max(0.03 * want[s], 2 * 64) for s in want)
    mix = mixing.Mix(df)
    texts = mix.texts(df.where("source = 'a'"))
    assert texts.where(F.size("words") == 0).count() == 0
    assert mixing.Mix(df.limit(0)).taken().count() == 0


def test_taken_words_are_those_of_the_placed_blocks(spark):
    r = np.random.default_rng(8)
    rows = [(k, " ".join(f"d{k}_{j}" for j in range(int(r.integers(0, 400)))), f"s{k % 3}") for k in range(120)] + [(500, " ".join(f"long{j}" for j in range(30_000)), "s1")]
    df = frame(spark, rows, "doc_id long, text string, source string")
    mix = mixing.Mix(df, per_shard=50, bucket_rows=7)
    taken = {x.doc_id: x.taken for x in mix.taken().collect()}
    placed = mix.placed().collect()
    slots = Counter((x.shard, x.slot, x.s) for x in placed)
    assert len({(x.shard, x.s, x.slot) for x in placed}) == len(slots)
    words = Counter()
    pieces = {}
    for x in mix.pieces.collect():
        pieces.setdefault((x.s, x.block), []).append((x.row, x.start, x.n_words))
    ids = {x.row: x.doc_id for x in mix.rows.collect()}
    used = Counter((x.s, x.block) for x in mix.slots.collect())
    assert max(used.values()) <= 2
    for key, n in used.items():
        for row, _, size in pieces[key]:
            words[ids[row]] += n * size
    assert {d: n for d, n in taken.items() if n} == {d: n for d, n in words.items() if n}
    # The blocks of a source hold each word of its documents once, 64 at a time.
    by_block = Counter()
    for (s, _), found in pieces.items():
        by_block[s] += sum(n for _, _, n in found)
        assert sum(n for _, _, n in found) <= 64
    assert sorted(by_block.values()) == sorted(Counter({s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("s0", "s1", "s2")}).values())


def test_slots_are_never_broadcast(spark):
    rows = [(k, "w " * 200, f"s{k % 2}") for k in range(50)]
    placed = mixing.Mix(frame(spark, rows, "doc_id long, text string, source string")).placed()
    assert placed.count() > 150
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin(\(\S+\))? \[s#\d+L?, block#", plan) and not re.search(r"BroadcastHashJoin \[[^]]*block#", plan)


def test_running_sums(spark):
    rows = [("a", k, k % 5) for k in range(50)] + [("b", k * 3, 1) for k in range(9)]
    got = {(x.k, x.at): x["from"] for x in mixing.before(spark.createDataFrame(rows, "k string, at long, n long"), "k", "at", "n", 4).collect()}
    assert got == {(k, at): sum(n for q, b, n in rows if q == k and b < at) for k, at, _ in rows}


def test_permutations():
    for n in (1, 2, 3, 10, 1000, 4097):
        for key in (0, 1, 99):
            got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(got.tolist()) == list(range(n))


def test_webp_round_trips():
    r = np.random.default_rng(0)
    for w, h in ((1, 1), (7, 5), (33, 20)):
        image = webp.packed(r.integers(0, 256, (h, w, 4)) // int(r.integers(1, 60)))
        few = webp.packed(np.array([[255, 10, 20, 30], [255, 200, 3, 4], [0, 0, 0, 0], [255, 1, 2, 3], [9, 9, 9, 9]])[r.integers(0, 5, (h, w))])
        th, tw = -(-h // 4), -(-w // 4)
        modes, cross = r.integers(0, 14, (th, tw)), webp.packed(r.integers(0, 256, (th, tw, 4)))
        for options in ({}, {"green": True}, {"cache_bits": 5}, {"refer": False}, {"predictor": modes}, {"cross": cross}, {"predictor": modes, "cross": cross, "green": True, "cache_bits": 3}):
            assert (webp.decode(webp.encode(image, **options)) == image).all(), options
        for options in ({"palette": True}, {"palette": True, "cache_bits": 4}):
            assert (webp.decode(webp.encode(few, **options)) == few).all(), options
    two = np.array([[webp.packed(np.array([255, 1, 1, 1])), webp.packed(np.array([255, 2, 2, 2]))] * 9] * 3)
    assert (webp.decode(webp.encode(two, palette=True)) == two).all()
    good = webp.encode(image)
    for bad in (b"", b"RIFF", good[:30], good[:20] + b"\x00" + good[21:]):
        with pytest.raises((ValueError, IndexError)):
            webp.decode(bad)


def test_media_of_texts(spark):
    r = np.random.default_rng(1)
    texts = ["", None, "x", "y" * 575, "y" * 576, "é" * 288, "ab" * 5000, "same", "same", "".join(map(chr, r.integers(32, 1000, 3000)))] + ["".join(map(chr, r.integers(97, 123, int(n)))) for n in r.integers(1, 4000, 150)]
    df = frame(spark, list(enumerate(texts))).withColumn("media", F.lit("clash"))
    stored = media.store_texts(df)
    got = {x.doc_id: x for x in media.describe_media(stored).collect()}
    files = {x.doc_id: bytes(x.media) for x in stored.collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-(-max(len(raw), 1) // 576) * 576 - len(raw))
        x = got[k]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (x.media_bytes, x.media_sha256) == (len(files[k]), hashlib.sha256(files[k]).hexdigest())
        assert ((webp.decode(files[k]) >> 8) & 255).astype(np.uint8).tobytes() == payload  # the general decoder agrees
    assert got[7][1:] == got[8][1:] and got[0][1:] == got[1][1:]
    kinds = [webp.head(webp.stream_of(files[k]))[0].read(3) for k in range(len(texts))]
    assert kinds.count(webp.PALETTE << 1 | 1) > 140 and kinds.count(0) > 3  # texts of many characters have a palette
    broken = frame(spark, [(1, b"junk"), (2, None), (3, files[3])], "doc_id long, media binary")
    arrays = {x.doc_id: x for x in media.pixel_arrays(broken).collect()}
    assert arrays[1].pixels is None and arrays[2].pixels is None and len(arrays[3].pixels) == 576
    assert media.describe_media(media.store_texts(frame(spark, []))).count() == 0


def least_bits(counts):
    left, total = sorted(n for n in counts if n), 0
    while len(left) > 1:
        total += left[0] + left[1]
        left = sorted([left[0] + left[1], *left[2:]])
    return total


def test_code_lengths_are_optimal():
    r = np.random.default_rng(3)
    for _ in range(300):
        counts = r.choice([0, 0, 1, 1, 2, 3, 8, int(r.integers(1, 300))], int(r.integers(2, 300))).tolist() + [1, 2]
        lengths, short = webp.code_lengths(counts, 99), webp.code_lengths(counts)
        assert sum(2.0**-n for n in lengths if n) == sum(2.0**-n for n in short if n) == 1 and max(short) <= 12
        assert sum(map(np.prod, zip(lengths, counts))) == least_bits(counts)
    assert webp.code_lengths([0, 5]) == [0, 1] and webp.code_lengths([0, 0]) == [0, 0]


def test_media_files_have_palette_predictor_and_cache():
    r = np.random.default_rng(4)
    text = lambda n, a, b: "".join(map(chr, r.integers(a, b, n))).encode()
    texts = [text(5000, 32, 90), text(300, 97, 123), text(4000, 32, 2000), text(64, 32, 100) * 90, b"".join(text(60, 32, 99) * 9 + text(36, 32, 99) for _ in range(9)), text(576, 40, 70), text(1 << 13, 0, 128), b"ab" * 700, b""]
    texts += [bytes([k]) * 576 + text(576, 32, 99) for k in (0, 65, 255)] + [text(int(n), 97, 123) for n in r.integers(1, 3000, 80)]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    files = media.encode_payloads(np.frombuffer(b"".join(texts), np.uint8), offsets)
    lanes = [media._Lane(f) for f in files]
    rich = [k for k, t in enumerate(texts) if len(set(t)) > 16]
    assert all(x.plain for x in lanes) and len(rich) > 80
    assert all(lanes[k].palette is not None and lanes[k].mode in (0, 1, 2) and lanes[k].cache for k in rich)
    assert {lanes[k].mode for k in rich} >= {0, 1} and any((lanes[k].array >> 4 & media.CACHED).any() for k in rich)
    for some in (slice(None), slice(0, 9)):  # together, and one by one
        for file, t, green in zip(files[some], texts[some], media.decode_greens(files[some]), strict=True):
            assert green.tobytes() == t.ljust(-(-max(len(t), 1) // 576) * 576, b"\xff")
            assert (((webp.decode(file) >> 8) & 255).ravel() == green).all()
    image = np.frombuffer(text(24 * 7, 0, 256)[: 24 * 7], np.uint8).reshape(7, 24)
    for mode in (0, 1, 2):
        assert (media.restored(media.residuals(image, mode), mode) == image).all()
        whole = webp.encode(image.astype(np.int64) << 8 | 255 << 24, predictor=np.full((2, 6), mode))
        assert (webp.decode(whole) >> 8 & 255 == image).all()
    # Other streams with a cache: places that several samples share, and pixels of more than one channel.
    for pixels in (np.arange(576).reshape(1, 576) % 199 << 8 | 255 << 24, np.arange(1152).reshape(2, 576) % 50 << 8 | 7):
        for bits in (1, 4, 8, 11):
            assert (media.decode_greens([webp.encode(pixels, cache_bits=bits, refer=False)])[0] == (pixels.ravel() >> 8 & 255)).all()


def test_media_of_texts_that_fit_no_image(spark, monkeypatch):
    monkeypatch.setattr(media, "HIGHEST", 2)
    monkeypatch.setattr(media, "WIDEST", 1200)
    data = "".join(chr(97 + k % 26) for k in range(5000)).encode()
    assert media.most_bytes() == 2304 and media.shape_of(2304) == (1152, 2)
    with pytest.raises(ValueError):
        media.shape_of(2305)
    for n in (2304, 2000, 1153):
        file = media.encode_payloads(np.frombuffer(data[:n], np.uint8), np.array([0, n]))[0]
        assert media.decode_greens([file])[0][:n].tobytes() == data[:n]


def brute_rule(host, path):
    best = None
    for h, p, verdict in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best or (None, None)


def test_url_filter(spark):
    urls = ["http://A.Example.NET/en/1?q#f", "https://example.com/de/2", "http://x.example.com/fr/", "https://www.bad.org", "ftp://y.org/fr/3", "nothing", None, "://", "http://notnet", "http://Ünet.net?x=/en/", "http://host.com#://b.net/", "http://"]
    rows = [(k, u) for k, u in enumerate(urls)] + [(100 + k, f"http://spam.example.com/x/{k}") for k in range(60)] + [(200 + k, f"http://good.example.com/x/{k}") for k in range(60)] + [(0, urls[0])]
    pages = frame(spark, rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    outcomes = frame(spark, [(100 + k, 1) for k in range(60)] + [(200 + k, 0) for k in range(60)], "page_id long, bad int")
    out = url_filter.judge_urls(pages, outcomes).collect()
    assert len(out) == len(rows)
    for x in out:
        url = dict(rows)[x.page_id]
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            m = re.match(r"([^/?#]*)([^?#]*)", rest)
            host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
        rule, verdict = brute_rule(host, path)
        assert (x.host, x.path, x.rule) == (host, path, rule)
        assert x.verdict == (verdict or ("block" if host == "spam.example.com" else "allow")), url
    by_host = {x.host: x for x in out}
    assert by_host["good.example.com"].high < 0.2 < by_host["x.example.com"].mean < by_host["spam.example.com"].low
    assert url_filter.judge_urls(pages.limit(0), outcomes.limit(0)).count() == 0 and url_filter.judge_urls(pages, None).count() == len(rows)
