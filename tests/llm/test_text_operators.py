import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from chronoloom.llm import decontam, langid, substring, toxicity
from chronoloom.llm.boosting import boost, isotonic
from chronoloom.llm.tokens import find_words, word_hashes

DATA = "/root/testdata/sf0.001"
LONG = "wort " * 60_000


def buffer(texts):
    return toxicity.as_buffer(texts)


def test_words_equal_a_plain_split_and_stay_within_texts():
    texts = ["Hello, World", "", "ÉTÉ été", "x" * 300, "a1-b2", "joined"]
    data, offs = buffer(texts)
    w = find_words(data, offs)
    got = [data[s:e].tobytes().decode() for s, e in zip(w.start, w.end, strict=True)]
    assert got == ["Hello", "World", "ÉTÉ", "été", "x" * 300, "a1", "b2", "joined"]
    assert w.row.tolist() == [0, 0, 2, 2, 3, 4, 4, 5]
    assert w.hash[2] == w.hash[3] and len(set(w.hash.tolist())) == 7
    assert word_hashes("hello") == w.hash[0]


# ---- operator 3


def plain_units(text, kind, least):
    """(start, stop, words) of units, character by character: from each sentence (line, paragraph) on until there are enough words."""
    raw = text.encode()
    line = [i + 1 for i, c in enumerate(raw) if c == 10]
    if kind == "line":
        cuts = line
    elif kind == "paragraph":
        cuts = [i + 2 for i in range(len(raw) - 1) if raw[i] == raw[i + 1] == 10]
    else:
        cuts = sorted({*line, *[i + 1 for i, c in enumerate(raw[:-1]) if c in b".!?" and raw[i + 1] in b" \n\t\r"]})
    parts, begin = [], 0
    for cut in [*cuts, len(raw)]:
        spans, at = [], None
        for i, c in enumerate(raw[begin:cut] + b" "):
            word = c >= 128 or chr(c).isalnum()
            if word and at is None:
                at = i
            if not word and at is not None:
                spans.append((begin + at, begin + i))
                at = None
        if spans:
            parts.append(spans)
        begin = cut
    out = []
    for k in range(len(parts)):
        spans = []
        for part in parts[k:]:
            spans += part
            if len(spans) >= least:
                out.append((spans[0][0], spans[-1][1], tuple(raw[s:e].decode().lower() for s, e in spans)))
                break
    return out


def plain_repeats(rows, least, kinds=substring.KINDS):
    out = []
    for kind in kinds:
        seen = {}
        for doc, text in sorted(rows):
            for s, e, w in plain_units(text or "", kind, least):
                if w in seen and not (seen[w][0] == doc and s < seen[w][2]):
                    out.append((doc, kind, s, e, len(w), *seen[w][:2]))
                seen.setdefault(w, (doc, s, e))
    return sorted(out)


def repeats(df, **options):
    return sorted((r.doc_id, r.kind, r.start, r.stop, r.words, r.kept_doc_id, r.kept_start) for r in substring.repeated_units(df, **options).collect())


def test_repeated_units_against_a_plain_loop(spark):
    rows = [(2, "One two three. Four five six!\nOne, TWO  three"), (1, "one two three? x\nfour five six"), (3, None), (4, ""), (5, "été à là. ÉTÉ À LÀ."), (6, LONG)]
    rows += [(7, "aa bb. cc. dd ee.\n\nff gg hh\n"), (8, "Zz. aa bb. CC. dd, ee!\n\nff gg hh"), (9, "k. " * 30)]
    df = spark.createDataFrame([(a, b, 7) for a, b in rows], "doc_id long, text string, words int")
    for least in (1, 3, 5):
        got = repeats(df, least=least)
        assert got == plain_repeats(rows, least) and len(got) >= 4
        assert {r[1] for r in got} == set(substring.KINDS) or least > 1
    assert repeats(df, kinds=("line",), least=3) == plain_repeats(rows, 3, ("line",))
    assert substring.repeated_units(df.limit(0)).count() == 0
    cut = {r.doc_id: r.text for r in substring.without_repeats(df, least=3).collect()}
    assert cut[2] == ". !\n" and cut[5] == "été à là. ." and cut[3] is None and cut[1] == rows[1][1]


def test_cut_texts_of_odd_tables(spark):
    rows = [(1, "a b c d e. x", "old"), (1, "a b c d e. x", "old"), (1, "q. a b c d e", "old"), (None, "A b c d e", "old"), (2, "a B c d e\nz", "old")]
    df = spark.createDataFrame(rows, "DOC_ID long, Text string, Removed string")
    out = substring.without_repeats(df, least=5)
    assert out.columns == ["DOC_ID", "Text", "removed"]
    left = sorted((r[0] or 9, r[1]) for r in out.collect())
    # The two texts of id 1 are told apart; one of them keeps the unit, and equal rows are cut alike.
    assert left in ([(1, ". x"), (1, ". x"), (1, "q. a b c d e"), (2, "\nz"), (9, "")], [(1, "a b c d e. x"), (1, "a b c d e. x"), (1, "q. "), (2, "\nz"), (9, "")])
    assert substring.without_repeats(df.limit(0)).count() == 0


def test_substring_query_against_a_plain_loop(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.kind, r.start, r.stop, r.words, r.kept_doc_id, r.kept_start) for r in substring.op3_substring(spark, DATA).collect())
    assert got == plain_repeats(docs, substring.MIN_WORDS) and got


def test_repeated_rows_and_null_ids_are_listed_once(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert [(r.doc_id, r.kept_doc_id) for r in substring.repeated_units(df, kinds=("sentence",), least=6).collect()] == [(None, 1)]


# ---- operator 6


def enumerate_log_probability(word, table):
    """log of the sum over every segmentation of ``word`` into pieces of ``table``."""
    total = [0.0] + [-np.inf] * len(word)
    for end in range(1, len(word) + 1):
        ways = [total[start] + np.log(table[word[start:end]]) for start in range(max(0, end - 40), end) if word[start:end] in table]
        total[end] = np.logaddexp.reduce(ways)
    return total[-1]


def test_forward_sums_all_segmentations():
    pieces = sorted({bytes([b]) for b in range(256)} | {b" a", b"ab", b"abc", b"bc", b" x", "é".encode(), b" abc", b"c, ", b",", b"abcabcabcabcabc"})
    model = langid.fit({"l": Counter(t.encode() for t in "abc ab xabc abé abcabc".split()), "m": Counter([b"xx", b"xab"])}, pieces)
    for text in ("Abc xab abé " + "abc" * 20, "abc, x\tx-9 " + "abcé" * 500):
        for _ in range(2):  # the second time from the words kept
            total, words = model.log_likelihoods(*buffer([text]))
            assert words.tolist() == [len(text.split())]
            for k in range(2):
                probs = {p: model.table[i, k] for i, p in enumerate(pieces)}
                want = sum(enumerate_log_probability(b" " + w.lower().encode(), probs) for w in text.split())
                assert total[0, k] == pytest.approx(want, rel=1e-9)
    assert model.table.sum(axis=0) == pytest.approx(np.ones(2))


def test_expectations_of_one_round_against_all_segmentations():
    pieces = sorted({bytes([b]) for b in range(256)} | {b" a", b"ab", b"abc", b" abc"})
    start = {p: 0.05 ** len(p) for p in pieces}
    counts = {"l": {b"abc": 3, b"ba": 2}}
    want = Counter()

    def walk(word, at, used, p):
        if at == len(word):
            yield used, p
        for q in pieces:
            if word.startswith(q, at):
                yield from walk(word, at + len(q), [*used, q], p * start[q])

    for w, n in counts["l"].items():
        found = list(walk(b" " + w, 0, [], 1.0))
        for used, p in found:
            for q in used:
                want[q] += n * p / sum(x for _, x in found)
    got = np.array([want[q] + 0.01 * 0.5 ** len(q) + 1e-4 for q in pieces])
    model = langid.fit(counts, pieces, rounds=1)
    assert model.table[:-1, 0] == pytest.approx(got / got.sum())


def test_vocabulary_is_whole_and_long_texts_are_read_in_pieces(monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=langid.VOCABULARY)
    pieces = set(langid.load_pieces())
    plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    assert all(p.replace("▁", " ").encode() in pieces for p in plain if p == p.lower())
    model = langid.fit({"a": {b"foo": 2}, "b": {b"bar": 1}}, sorted(pieces))
    text = "foo bar, baz\n" * 200
    whole = model.log_likelihoods(*buffer([text]))
    monkeypatch.setattr(langid, "SLICE", 64)
    cut = model.log_likelihoods(*buffer([text]))
    assert cut[0] == pytest.approx(whole[0]) and cut[1].tolist() == whole[1].tolist() == [600]


def test_language_edge_cases(spark):
    model = langid.fit({"a": {b"foo": 2, b"bar": 1}, "b": {b"quux": 2, b"zap": 1}}, langid.load_pieces())
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (4, "foo foo bar", "x"), (5, "zap quux", None), (5, "zap quux", None), (6, "“…”", "x"), (7, LONG, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(df, model).orderBy("doc_id").collect()]
    assert [(d, p) for d, p, _ in got][:7] == [(1, "und"), (2, "und"), (3, "und"), (4, "a"), (5, "b"), (5, "b"), (6, "und")]
    assert all(0 <= s <= 1 for _, _, s in got)
    assert langid.identify(df.limit(0), model).count() == 0
    assert [r.doc_id for r in langid.keep_identified(df, model).orderBy("doc_id").collect()][:3] == [4, 5, 5]
    assert langid.keep_identified(df, model).columns == df.columns


def test_language_accuracy_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = langid.op6_langid(spark, sf).collect()
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(true)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == true[r.doc_id] for r in held) / len(held) > 0.97


# ---- operator 7


def test_boosting_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5)).astype(float)
    m = boost(x, y).margins(x)
    assert ((m > 0) == (y == 1)).mean() > 0.97
    scale = isotonic(m, y)
    s = scale(m)
    assert (np.diff(s[np.argsort(m)]) >= 0).all() and 0 < s.min() and s.max() < 1
    assert isotonic(np.zeros(0), np.zeros(0))(np.array([3.0])) == 0.5


def plain_tree(x, grad, hess, edges, depth, rate, least, ridge):
    """Every feature and edge tried by looping over rows; a function from a row to its leaf's value."""
    value = -rate * sum(grad) / (sum(hess) + ridge)
    best = (1e-6, None)
    if depth and len(grad) >= 2 * least:
        score = lambda rows: sum(grad[i] for i in rows) ** 2 / (sum(hess[i] for i in rows) + ridge)
        for k in range(x.shape[1]):
            for e in edges[k]:
                left = [i for i in range(len(x)) if x[i, k] <= e]
                right = [i for i in range(len(x)) if x[i, k] > e]
                if min(len(left), len(right)) >= least and (gain := score(left) + score(right) - score(range(len(x)))) > best[0] + 1e-9:
                    best = (gain, (k, e, left, right))
    if best[1] is None:
        return lambda row: value
    k, e, left, right = best[1]
    a, b = (plain_tree(x[part], grad[part], hess[part], edges, depth - 1, rate, least, ridge) for part in (left, right))
    return lambda row: a(row) if row[k] <= e else b(row)


def test_boosting_against_plain_loops():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 3)).round(1)
    y = ((x[:, 0] + 0.3 * rng.normal(size=150) > 0.2) ^ (x[:, 2] > 1)).astype(float)
    model = boost(x, y, trees=3, depth=2, bins=8, least=5)
    margin = np.full(150, np.log(y.mean() / (1 - y.mean())))
    for _ in range(3):
        q = 1 / (1 + np.exp(-margin))
        tree = plain_tree(x, q - y, q * (1 - q), model.edges, 2, 0.15, 5, 1.0)
        margin = margin + np.array([tree(row) for row in x])
    assert model.margins(x) == pytest.approx(margin, abs=1e-9)


def test_isotonic_against_the_max_min_formula():
    rng = np.random.default_rng(7)
    m = np.sort(rng.normal(size=40))
    y = (rng.random(40) < 1 / (1 + np.exp(-2 * m))).astype(float)
    w = rng.integers(1, 5, 40).astype(float)
    mean = lambda a, b: (y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
    want = np.array([max(min(mean(a, b) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)])
    scale = isotonic(m, y, w)
    # Blocks of equal fit, in order: inner ones have exactly their mean, the ends are smoothed by one row.
    blocks = [np.flatnonzero(want == v) for v in np.unique(want)]
    assert len(scale.at) == len(blocks)
    for i, rows in enumerate(blocks):
        assert scale.at[i] == pytest.approx((m[rows] * w[rows]).sum() / w[rows].sum())
        if 0 < i < len(blocks) - 1:
            assert scale.to[i] == pytest.approx(want[rows[0]])


def test_shares_of_labels_move_the_scores():
    texts, y = ["you idiot", "a fine day", "idiot proof"] * 40, np.array([1, 0, 0] * 40)
    even, rare = (toxicity.fit(texts, y, share=s).score(*buffer(["you idiot", "idiot proof"])) for s in (None, 0.01))
    assert (rare <= even + 1e-9).all()


def plain_features(text, lex):
    """FEATURES one character at a time."""
    weight = {int(k): v for k, v in zip(lex.keys, lex.weights, strict=True)}
    pronouns = {int(p) for p in lex.pronouns}
    lower = lambda t: "".join(c.lower() if c.isascii() or "À" <= c <= "Þ" else c for c in t)

    weigh = lambda word: weight.get(int(word_hashes(word)[0]), 0.0)  # the seed lexicon holds whole words only
    words = re.findall(r"[A-Za-z\x80-\U0010ffff]+", text)
    w = [weigh(x) for x in words]
    you = [int(word_hashes(x)[0]) in pronouns for x in words]
    hit = [x > 0 for x in w]
    n, raw = max(1, len(words)), text.encode()
    chars, low = max(1, len(raw)), lower(text).encode()
    near = sum(any(you[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1]) for i in range(len(words)) if hit[i])
    dense = max([0, *[sum(hit[max(0, i + 1 - 50) : i + 1]) for i in range(len(words)) if hit[i]]])
    letter = lambda c: c >= 128 or chr(c).isalpha()
    same = sum(low[i] == low[i - 1] == low[i - 2] and letter(low[i]) for i in range(2, len(low)))
    other = sum(33 <= c <= 126 and not chr(c).isalnum() and chr(c) not in "!?,." for c in raw)
    return {
        "listed": sum(hit) / n, "log listed": np.log1p(sum(hit)), "any listed": float(any(hit)), "densest": dense, "weight": sum(w) / n, "near": near / n, "you": sum(you) / n,
        "capitals": sum(65 <= c <= 90 for c in raw) / chars, "exclamation": raw.count(b"!") / chars, "question": raw.count(b"?") / chars, "other": other / chars, "same": same / chars,
        "log words": np.log1p(len(words)), "word bytes": sum(len(x.encode()) for x in words) / n,
    }


def test_features_against_plain_loops():
    lex = toxicity.seed_lexicon()
    rows = ["You are an IDIOT, idiots!!", "", "no... calm; words: here (really) [yes] #1", "Tú eres ESTÚPIDO? aaa bbbb cccc", "idiot " * 70 + "you", "x " * 60 + "loser you"]
    columns = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 13, 14, 15]
    got = toxicity.features(*buffer(rows), lex)
    for text, row in zip(rows, got, strict=True):
        for (name, want), k in zip(plain_features(text, lex).items(), columns, strict=True):
            assert row[k] == pytest.approx(want), (text[:30], name)


def test_toxicity_features_see_disguise_pronouns_and_caps():
    lex = toxicity.seed_lexicon()
    rows = ["You are an idiot", "IDIOT!!! LOSER", "an 1d1ot and an id!ot here", "calm words here", "", "you " * 30]
    x = dict(zip(rows, toxicity.features(*buffer(rows), lex), strict=True))
    at = {n: i for i, n in enumerate(toxicity.FEATURES)}
    assert x[rows[0]][at["listed"]] > 0 and x[rows[0]][at["second person near listed"]] > 0
    assert x[rows[1]][at["capitals"]] > 0.5 and x[rows[1]][at["exclamation"]] > 0
    assert x[rows[2]][at["disguised listed"]] > 0 and x[rows[3]][at["listed"]] == 0
    assert not x[""].any() and x[rows[5]][at["second person"]] == 1


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in toxicity.op7_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(rows[d], t) for d, t in labels.items() if rows[d].held_out]
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    hit = sum(r.predicted for r, t in held if t) / sum(t for _, t in held)
    false = sum(r.predicted for r, t in held if not t) / sum(1 - t for _, t in held)
    assert hit > 0.85 and false < 0.01
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows.values())


def test_toxicity_of_odd_rows(spark):
    model = toxicity.fit(["you idiot", "a fine day"] * 30, np.array([1, 0] * 30))
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "you idiot", 0), (3, LONG, 0), (3, LONG, 0)], "doc_id long, text string, predicted int")
    got = toxicity.score(df, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert toxicity.score(df.limit(0), model).count() == 0


# ---- operator 8


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence_matches_the_table_method():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        masks = defaultdict(int)
        for i, x in enumerate(b):
            masks[x] |= 1 << i
        assert decontam.common_length(a, masks, len(b)) == plain_common(a, b)


def planted(spark):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(3000)]
    talk = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, talk(rng.randrange(15, 60))) for i in range(30)] + [(30, None), (31, ""), (32, talk(150))]
    docs, want = [], set()
    for d in range(300):
        words = talk(rng.randrange(5, 400)).split()
        if d % 10 == 0:
            i, text = items[(d // 10) % 30]
            at = rng.randrange(len(words) + 1)
            part = text.split()
            if d % 20 == 0:  # some words replaced
                for k in rng.sample(range(len(part)), len(part) // 10):
                    part[k] = rng.choice(vocab)
            words[at:at] = [w.upper() if d % 30 == 0 else w for w in part]
            want.add((d, i))
        docs.append((d, " ".join(words), "kept"))
    docs += [(900, None, ""), (901, "", ""), (902, LONG, ""), (903, "xx " + items[32][1] + " yy", ""), (903, "xx " + items[32][1] + " yy", "")]
    want.add((903, 32))
    return spark.createDataFrame(docs, "doc_id long, text string, lcs string"), spark.createDataFrame(items, "item_id long, text string"), want


def test_planted_items_are_found_and_nothing_else(spark):
    docs, items, want = planted(spark)
    got = Counter((r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect())
    assert set(got) == want and got[903, 32] == 2
    kept = decontam.without_leaks(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_nothing_to_search_or_to_find(spark):
    docs, items, _ = planted(spark)
    assert decontam.leaks(docs.limit(0), items).count() == 0
    assert decontam.leaks(docs, items.limit(0)).count() == 0
    assert decontam.without_leaks(docs, items.limit(0)).count() == docs.count()


def test_decontamination_query_against_word_runs(spark):
    """Brute force: a document leaks an item if over 40 % of the item's runs of five words stand in it."""
    sf = "/root/testdata/sf0.01"

    words = lambda t: re.findall(r"\w+", (t or "").lower())
    runs = defaultdict(set)
    sizes = {}
    for i, t in duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall():
        w = words(t)
        sizes[i] = max(1, len(w) - 4)
        for k in range(len(w) - 4):
            runs[tuple(w[k : k + 5])].add(i)
    want = set()
    for d, t in duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall():
        w = words(t)
        hits = Counter(i for k in range(len(w) - 4) for i in runs.get(tuple(w[k : k + 5]), ()))
        want |= {(d, i) for i, n in hits.items() if n / sizes[i] > 0.4}
    got = {(r.doc_id, r.item_id) for r in decontam.op8_decontam(spark, sf).collect()}
    assert got == want and got
