import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexmill.llm import common, decontamination, html_text, language_id, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, rows):
    return spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in rows], DOC)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_words_and_grams():
    texts = ["The cat  sat", "", None, "the CAT", " x\x0by", " z ", "cat sat"]
    h, starts, ends, rows = common.words(*common.utf8(pa.array(texts)))
    data, _ = common.utf8(pa.array(texts))
    got = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    assert got == ["The", "cat", "sat", "the", "CAT", " x", "y", "z", "cat", "sat"]
    assert rows.tolist() == [0, 3, 3, 3, 5, 7, 8, 10]
    assert h[0] == h[3] and h[1] == h[4] == h[8] and h[2] == h[9] and len({int(x) for x in h}) == 6
    g = common.grams(h, 2)
    assert g[0] == g[3] and g[1] == g[8] and g[0] != g[1]
    sliced = pa.array(["skip", *texts]).slice(1)
    assert common.words(*common.utf8(sliced))[0].tolist() == h.tolist()


def brute_phrases(text, sample):
    count = at = 0
    while at < len(text):
        n = 0
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        at += max(n, 1)
        count += 1
    return count


def test_automaton_counts_phrases_like_a_search():
    r = np.random.default_rng(4)
    sample, other = "".join(r.choice(list("abc"), 300)), "cab" * 100
    model = language_id.Model({"x": [sample], "y": [other]}, 10_000)
    texts = ["".join(r.choice(list("abc"), n)) for n in (1, 7, 60, 200)]
    phrases, lengths = model.phrases(texts, block=10_000)
    assert lengths.tolist() == [len(t) for t in texts]
    for k, part in enumerate((sample, other)):
        assert phrases[:, k].tolist() == [brute_phrases(t, part) for t in texts]
    # With the default blocks, a phrase ends with its block too.
    long = "".join(r.choice(list("abc"), 3000))
    blocks = [long[k : k + 1024] for k in range(0, 3000, 1024)]
    assert model.phrases([long])[0].tolist() == [[sum(brute_phrases(x, part) for x in blocks) for part in (sample, other)]]


def test_parsing_holds_little_besides_the_codes():
    r = np.random.default_rng(2)
    model = language_id.Model({"aa": ["some words of one language"], "bb": ["others, in another one"]}, 1000)
    texts = ["".join(map(chr, r.choice([32, 46, 49, 97, 98, 101, 111, 1078], int(n)))) for n in (0, 3, 700, 0, 9, 1500, 0)]
    want = model.codes("".join(texts), np.array([len(x) for x in texts]))
    for most in (1, 10, 720, 1 << 19):
        for a, b in zip(model.codes_of(texts, np.array([len(x) for x in texts]), most), want, strict=True):
            assert (a == b).all()
    tracemalloc.start()
    model.phrases(["one of many texts. " * 100] * 2000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # 3.8 million codes


def test_languages_with_short_texts_or_large_alphabets(spark):
    r = np.random.default_rng(3)
    vocabulary = {
        "aa": ["".join(r.choice(list("abcdefgh"), 4)) for _ in range(60)],
        "bb": ["".join(r.choice(list("efghijkl"), 4)) for _ in range(60)],
        "cc": ["".join(chr(x) for x in r.integers(0x4E00, 0x4E00 + 3000, 3)) for _ in range(300)],
        "dd": ["".join(chr(x) for x in r.integers(0xAC00, 0xAC00 + 3000, 3)) for _ in range(300)],
    }
    text = lambda lang, n: " ".join(r.choice(vocabulary[lang], n))
    sizes = {"aa": 80, "bb": 8, "cc": 90, "dd": 40}  # bb: under 200 characters each
    rows = [(k, text(lang, sizes[lang]), lang) for k, lang in enumerate(["aa", "bb", "cc", "dd"] * 30)]
    rows += [(1000, text("bb", 6000), "ee"), (1001, text("aa", 3), "aa")]  # ee: one text, which is very long
    docs = corpus(spark, rows)
    model = language_id.train(docs)
    assert model.langs == ["aa", "bb", "cc", "dd", "ee"][: 4 + (zlib.crc32(b"1000") % 4 != 2)]
    fresh = corpus(spark, [(k, text(lang, 12), lang) for k, lang in enumerate(["aa", "bb", "cc", "dd"] * 10)])
    got = [(x.lang, x.lang_pred) for x in language_id.identify(fresh, model).collect()]
    assert all(p == lang or (lang, p) == ("bb", "ee") for lang, p in got)


def test_ties_and_null_ids(spark):
    docs = corpus(spark, [(1, "abab abab " * 30, "x"), (3, "abab abab " * 30, "y"), (None, "abab", None)])
    model = language_id.train(docs)
    got = language_id.identify(docs, model).collect()
    assert model.langs and {x.lang_pred for x in got} == {model.langs[0]} and all(0 <= x.score <= 1 for x in got)


LANGS = {"aa": "the cat and the dog are in the house of the man ", "bb": "le chat et le chien sont dans la maison de homme "}


def test_language_identification(spark):
    r = np.random.default_rng(0)
    made = [(k, " ".join(r.permutation(LANGS[lang].split() * 8)), lang) for k, lang in enumerate(["aa", "bb"] * 40)]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !!", "bb"), (None, LANGS["bb"] * 3, None), (1003, LANGS["aa"], None), (1003, LANGS["aa"], None), (1004, LANGS["aa"] * 3000, "aa")]
    docs = corpus(spark, made + odd).withColumn("score", F.lit("clash"))
    out = language_id.identify(docs, language_id.train(docs))
    assert out.columns.count("score") == 1
    got = [(r.doc_id, r.lang_pred, r.lang) for r in out.collect()]
    assert len(got) == len(made + odd)
    assert all(p == lang for d, p, lang in got if d is not None and d < 1000)
    assert sorted(p for d, p, _ in got if d in (1000, 1001, 1002)) == ["und"] * 3
    assert [p for d, p, _ in got if d in (1003, 1004)] == ["aa"] * 3 and [p for d, p, _ in got if d is None] == ["bb"]
    empty = docs.limit(0)
    assert language_id.identify(empty, language_id.train(empty)).count() == 0


def test_disguised_words_are_restored():
    text = "you are an idiot and a moron with no shame so stupid and pathetic is this loser trash " * 50
    restorer = toxicity.Restorer(toxicity.CharModel(toxicity.count_ngrams([text])))
    cases = {
        "1d10t": "idiot", "m0r0n": "moron", "i d i o t": "idiot", "i  d  i  o  t": "idiot", "stuuuupid": "stupid", "stuupid": "stupid", "iidioot": "idiot",
        "l0$er": "loser", "tr@sh": "trash", "p.a.t.h.e.t.i.c": "pathetic", "IDIOT!!": "idiot", "1 d 1 0 t": "idiot", "(1d10t)": "idiot", "/m0r0n/": "moron", "70 1053r": "loser",
        "i" * 60 + "d" + "i" * 9 + "oooot": "idiot", "y o u a r e a n i d i o t a n d a m o r o n w i t h n o s h a m e": "moron",
    }
    for disguised, word in cases.items():
        assert word in restorer.words(disguised), disguised
    assert {"idiot", "moron", "shame"} <= restorer.words("y o u a r e a n i d i o t a n d a m o r o n w i t h n o s h a m e")
    assert restorer.words("") == set() and "2" in restorer.words("2 + 2") and restorer.words("no shame") == {"no", "shame"}


def test_decoding_is_the_best_of_all_paths():
    from itertools import product

    r = np.random.default_rng(6)
    model = toxicity.CharModel(toxicity.count_ngrams(["an idiot and a moron sit on a little stool " * 20]))

    def value(choice):
        state, p = 0, 0.0
        for letters, cost in choice:
            p += cost
            for code in toxicity.codes_of(letters):
                state, q = model.step(state, code)
                p += q
        return p + model.step(state, 0)[1]

    for _ in range(60):
        token = "".join(r.choice(list("idot10aa@.m"), int(r.integers(1, 7))))
        for breaks in (False, True):
            options = [toxicity.options_of(c, more, breaks) for c, more in toxicity.runs_of(token)]
            best = max(product(*options), key=value)
            got = toxicity.decode(token, model, breaks)
            assert abs(max(value(x) for x in product(*options) if "".join(y for y, _ in x) == got) - value(best)) < 1e-9


def test_long_tokens_are_decoded_in_linear_time():
    import time

    model = toxicity.CharModel(toxicity.count_ngrams(["an idiot and a moron " * 20]))
    r = np.random.default_rng(2)
    token = "".join(r.choice(list("abcdefgh0123456789@$"), 40_000))
    began = time.time()
    assert len(toxicity.decode(token, model)) > 10_000 and time.time() - began < 20


def test_character_model_sums_to_one():
    model = toxicity.CharModel(toxicity.count_ngrams(["some words here", "and some more"]))
    p = np.exp(np.array(model.log)).reshape(-1, toxicity.SIZE).sum(1)
    assert np.allclose(p, 1)


def test_toxicity_learns_outside_the_held_out_fold(spark):
    r = np.random.default_rng(2)
    plain, bad = "some quiet words about the garden and rain".split(), "idiot moron".split()
    rows, labels = [], []
    for k in range(400):
        words = list(r.choice(plain, 12)) + (list(r.choice(bad, 3)) if k % 2 else [])
        rows.append((k, " ".join(r.permutation(words)), "aa"))
        labels.append((k, 1, k % 2))
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "1d10t m0r0n " * 4000, "aa"), (None, "moron", None), (5, rows[5][1], "aa")]
    docs = corpus(spark, rows)
    marks = spark.createDataFrame(labels + [(7, 0, None)], "doc_id long, quality int, toxic int")
    model, scorer = toxicity.train(docs, marks)
    got = [(r.doc_id, r.score) for r in toxicity.score(docs, model, scorer).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    held = [(d, s) for d, s in got if d is not None and d < 400 and zlib.crc32(str(d).encode()) % 4 == 2]
    assert held and all((s >= 0.3) == bool(d % 2) for d, s in held)
    assert dict(got)[1002] > 0.9 and dict(got)[1000] == dict(got)[1001] < 0.5  # half of the labels are toxic
    none = toxicity.train(docs.limit(0), marks.limit(0))
    assert toxicity.score(docs.limit(0), *none).count() == 0


def test_extraction_on_fresh_labelled_pages():
    model = html_text.trained()
    whole = right = 0
    for page, main in html_text.labelled_pages(80, seed=99):
        found = html_text.blocks(page)
        want = html_text.label(found, main)
        assert sum(want) == len(main)
        whole += len(want)
        right += sum(a == b for a, b in zip(want, model.decode(found)))
    assert right / whole > 0.99


def test_viterbi_is_the_best_path():
    from itertools import product

    model = html_text.trained(html_text.labelled_pages(20))
    found = html_text.blocks(html_text.labelled_pages(3, seed=8)[2][0])[:9]
    e = [model.emission(b) for b in found]

    def value(y):
        return model.start[y[0]] + sum(x for x, k in zip(e, y) if k) + sum(model.pairs[a][b] for a, b in zip(y, y[1:]))

    assert abs(value(model.decode(found)) - max(map(value, product((0, 1), repeat=len(found))))) < 1e-9


def test_extraction_of_odd_pages(spark):
    page = '<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>One &amp; two</h1><p>First para,\n with  words. &lt;b&gt; and 1 < 2.<p>Second &eacute;t&eacute; para, it ends.</article><div class="comments"><p>Reader says, hello there.</p></div><footer>&copy; me</footer>'
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "no markup at all"), (5, "u", "<p"), (1, "u", page), (6, "u", "<article><p>" + "long words here, yes. " * 20_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = [tuple(r) for r in html_text.extract(df, html_text.trained()).collect()]
    got = {r[0]: r[2] for r in out}
    assert len(out) == 7 and got[2] == got[3] == got[5].replace("<p", "") == ""
    assert got[1] == "One & two First para, with words. <b> and 1 < 2. Second été para, it ends."
    assert len(got[6]) == len("long words here, yes. ") * 20_000 - 1 and all(r[3] == len(r[2]) for r in out)


def test_extraction_is_linear_in_hostile_pages(spark):
    import time

    model = html_text.trained(html_text.labelled_pages(40))
    pages = ["<a " * 330_000, "<div>" * 200_000, "<div>x" * 100_000, "<b>" * 50_000 + "</i>" * 200_000, "<!" * 500_000, '<a "' * 250_000 + ">", "<li>x" * 100_000, "<script>" * 100_000]
    for page in pages:
        began = time.time()
        html_text.main_text(page, model)
        assert time.time() - began < 5, page[:10]
    deep = html_text.blocks("<article>" + "<div class=a>" * 600 + "<p>inner" + "</div>" * 600 + "<p>after</article><p>beyond")
    assert [b.text for b in deep] == ["inner", "after", "beyond"] and "<article>" in deep[1].path and "<article>" not in deep[2].path
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(empty, model).count() == 0


def brute_alignment(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_equals_the_plain_recurrence():
    r = np.random.default_rng(1)
    for _ in range(40):
        a, b = r.integers(0, 5, r.integers(1, 15)), r.integers(0, 5, r.integers(1, 30))
        assert decontamination.local_alignment(a, b)[0] == brute_alignment(a.tolist(), b.tolist())


def test_leaks(spark):
    r = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in r.integers(0, 4000, n)]
    items = [word(30) for _ in range(6)]
    edited = items[1].copy()
    edited[5] = edited[17] = "other"
    docs = [(1, " ".join(word(80) + items[0] + word(50))), (2, " ".join(word(10) + edited)), (3, " ".join(word(200))), (4, None), (5, ""), (6, " ".join(items[2]).upper()), (6, " ".join(items[2]).upper()), (None, " ".join(items[3])), (7, " ".join(word(30_000) + items[4]))]
    docs += [(100 + k, " ".join(items[5] + word(20))) for k in range(50)]  # a hot item
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(9, None), (10, "too short")], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontamination.find_leaks(df, bench).collect()]
    want = [(1, 0), (2, 1), (6, 2), (6, 2), (None, 3), (7, 4)] + [(100 + k, 5) for k in range(50)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sorted(got, key=repr) == sorted([(r.doc_id, r.item_id) for r in decontamination.find_leaks(df, bench, group_items=2).collect()], key=repr)
    assert decontamination.find_leaks(df.limit(0), bench).count() == 0 and decontamination.find_leaks(df, bench.limit(0)).count() == 0


def test_leaks_equal_the_alignment_of_everything(spark):
    r = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in r.integers(0, 900, n)]
    items = [word(int(n)) for n in r.integers(4, 40, 12)] + [["two", "words"], ["one"]]
    docs = []
    for k in range(160):
        w = list(items[k % 12])
        for _ in range(int(r.integers(0, 1 + len(w) // 3))):  # edits: more and more don't count as a copy
            at = int(r.integers(len(w)))
            w[at : at + 1] = [[], ["new"], ["one", "more"]][int(r.integers(3))] if len(w) > 3 else w[at : at + 1]
        docs.append((k, " ".join(word(int(r.integers(0, 30))) + w + word(int(r.integers(0, 30))))))
    docs += [(200, "Two words"), (201, "two words more"), (202, "one"), (203, "one one"), (204, " ")]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("score", F.lit(1))
    got = {(x.doc_id, x.item_id): x.score for x in decontamination.find_leaks(df, bench, rare=1.0).collect()}
    want, grams = {}, lambda w: {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    for d, text in docs:
        for k, item in enumerate(items):
            if len(item) < 3:
                if text.lower().split() == item:
                    want[d, k] = 1.0
            elif grams(item) & grams(text.split()) and (score := brute_alignment(item, text.split()) / (2 * len(item))) >= 0.6:
                want[d, k] = score  # a copy without a seed of three words isn't found: seeds are the method's first step
    assert got == want and len(want) > 100


def test_extra_columns_and_repeated_rows_of_scores(spark):
    docs = corpus(spark, [(1, "a calm day", "aa"), (1, "a calm day", "aa"), (2, "x" * 300_000, "aa"), (3, "", None)]).withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(7))
    marks = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    got = [(x.doc_id, x.score) for x in toxicity.score(docs, *toxicity.train(docs, marks)).collect()]
    assert len(got) == 4 and len({s for d, s in got if d == 1}) == 1
