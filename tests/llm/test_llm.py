"""The ten operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from causeway.llm import byte_bpe, embedding_dedup, exact_dedup, language_id, line_dedup, mixing, near_dedup, passage_dedup, pii, suffix_dedup, textkit
from causeway.llm.components import components

DOC = "doc_id long, text string, lang string, source string, _left long, kept string, n_removed string"


def prose(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Texts with copies, near copies, shared passages and lines, all odd cases, and columns that clash."""
    rnd = random.Random(3)
    base = [prose(rnd, rnd.randrange(60, 160)) for _ in range(12)]
    texts = base + [base[0], base[0].upper(), base[1] + " tail", " ".join(w if i % 40 else "x" for i, w in enumerate(base[2].split()))]
    passage = prose(rnd, 70)
    texts += [f"{prose(rnd, 30)} {passage} {prose(rnd, 30)}" for _ in range(4)]
    texts += ["line a\nline b\nline c", "other\nline a\nline b\nend", "line a\nline b\nline a\nline b", "\n\n\n", "\n\n\n\n", "", None, None, "é" * 300, "aaaa" * 200, "ab" * 700, prose(rnd, 6000)]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}", 1, "x", "y") for i, t in enumerate(texts)]
    rows += [rows[3], (None, "no id at all, but words enough", None, None, 1, "x", "y"), (2, "the same id with another text", "en", None, 1, "x", "y")]
    return spark.createDataFrame(rows, DOC).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def collected(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def order(x):
    return (x[0] is None, x[0] or 0)


def test_exact(docs, empty):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for i, t in collected(docs):
        groups[low(t)].append(i)
    for digest in (True, False):
        got = exact_dedup.exact_dedup(docs, digest_all=digest).collect()
        assert len(got) == docs.count()
        for r in got:
            same = groups[low(r.text)]
            keep = max((i for i in same if i is not None), default=None)
            assert (r.group_size, r.keep_id, r.kept) == (len(same), keep, r.doc_id == keep)
            if digest or len(same) > 1:
                assert r.text_sha256 == hashlib.sha256(low(r.text).encode()).hexdigest()
    assert exact_dedup.exact_dedup(empty).count() == 0


@pytest.fixture(scope="module")
def lined(spark):
    """Lines of all lengths, blank ones among them, between ever other neighbours; repeated rows, texts of one line, columns that clash."""
    rnd = random.Random(8)
    pool = ["a", "bb", "", " ", " " * 50, "39 characters of text, one too few, yes.", "x" * 39, "x" * 40, " " + "y" * 40 + "  ", "é" * 40, "boilerplate " * 5, "a license of some kind, version 3, or later"]
    rows = [(i, "\n".join(rnd.choice(pool) if rnd.random() < 0.6 else f"own line {rnd.randrange(10**6)}" for _ in range(rnd.randrange(1, 9))), "en", "s", 1, "x", "y") for i in range(3, 60)]
    return spark.createDataFrame([*rows, rows[5], (60, "x" * 40, None, None, 1, "x", "y"), (61, None, None, None, 1, "x", "y")], DOC).repartition(4).cache()


@pytest.mark.parametrize("table", ["docs", "lined"])
@pytest.mark.parametrize("alone", [None, 5, 40])
@pytest.mark.parametrize("run", [2, 3])
def test_lines(request, empty, run, alone, table):
    docs = request.getfixturevalue(table)
    got = line_dedup.line_dedup(docs, run=run, alone=alone).collect()
    assert len(got) == docs.count()
    places = defaultdict(list)
    rows = [(r.doc_id, r.text) for r in got if r.doc_id != 2]
    for i, t in rows:
        lines = (t or "").split("\n")
        for s in range(len(lines) - run + 1):
            w = "\n".join(lines[s : s + run])
            if w.replace(" ", "").replace("\n", ""):
                places[w].append((order((i,)), s))
        for s, x in enumerate(lines):
            if alone and len(x.strip(" ")) >= alone:
                places["alone", x].append((order((i,)), s))
    for r in got:
        if r.doc_id == 2:
            continue
        lines = (r.text or "").split("\n")
        gone = set()
        for s in range(len(lines) - run + 1):
            w = "\n".join(lines[s : s + run])
            if w in places and min(places[w]) < (order((r.doc_id,)), s):
                gone |= set(range(s, s + run))
        gone |= {s for s, x in enumerate(lines) if ("alone", x) in places and min(places["alone", x]) < (order((r.doc_id,)), s)}
        assert r.n_removed == len(gone) and [k for a, b in r.runs for k in range(a, b + 1)] == sorted(gone)
        assert all(b + 1 < a for (_, b), (a, _) in zip(r.runs, r.runs[1:]))
        assert r.n_lines == len(lines) and r.kept_text == "\n".join(x for k, x in enumerate(lines) if k not in gone)
    assert line_dedup.line_dedup(empty).count() == 0


def test_lines_need_their_fingerprints(spark, monkeypatch):
    """Runs come out of the fingerprints' positions: without these nothing is found; blank lines within and around runs do no harm."""
    rows = [(1, "a\nb\n\n\nc\nd\ne"), (2, "x\na\nb\n\n\nc\ny"), (3, "\n\n\nd\ne\n"), (4, "c\nd")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in line_dedup.line_dedup(df).collect()} == {1: 0, 2: 5, 3: 2, 4: 2}
    positions = line_dedup._positions
    monkeypatch.setattr(line_dedup, "_positions", lambda *a: positions(*a).where("false"))
    assert {r.n_removed for r in line_dedup.line_dedup(df).collect()} == {0}


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.p <= 1 for r in got)
    assert all(not r.kept and r.p == 0 for r in got if not (r.text or "").split())
    again = {(r.doc_id, r.text): r.kept for r in mixing.mix(docs.repartition(3)).collect()}
    assert all(again[(r.doc_id, r.text)] == r.kept for r in got)
    assert mixing.mix(empty).count() == 0


def test_raking_meets_the_marginals(spark):
    cells = spark.createDataFrame([(a, b, n) for a, b, n in [("x", "p", 10), ("x", "q", 30), ("*", "p", 40), ("*", "q", 5)]], "source string, lang string, tokens long").coalesce(1)
    targets = {"source": {"x": 0.7, "*": 0.3}, "lang": {"p": 0.2, "q": 0.6, "absent": 0.2}}
    rows = spark.sql(mixing.rake_sql("{cells}", targets, 40), cells=cells).collect()
    tokens = {("x", "p"): 10, ("x", "q"): 30, ("*", "p"): 40, ("*", "q"): 5}
    share = {(r.source, r.lang): r.ratio * tokens[(r.source, r.lang)] / 85 for r in rows}
    assert sum(v for (a, _), v in share.items() if a == "x") == pytest.approx(0.7)
    assert sum(v for (_, b), v in share.items() if b == "p") == pytest.approx(0.25)


def shares(rows, of):
    total = Counter()
    for r in rows:
        total[of(r)] += r.n_tokens
    return {k: n / sum(total.values()) for k, n in total.items()}


def test_the_drawn_sample_meets_the_production_targets(spark):
    """After the registered sweeps the expected shares are the targets', and the drawn ones are near them."""
    rnd = random.Random(30)
    rows = [(k, prose(rnd, rnd.choice([40, 300, 2500])), rnd.choices(["en", "de", "fr", "es", None], [5, 3, 3, 2, 1])[0], f"src{rnd.choice([0, 0, 0, 1, 2, 3, 4, 5, 6, 9])}") for k in range(1500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    cells = Counter()
    for r in got:
        cells[r.source if r.source in mixing.TARGETS["source"] else "*", r.lang if r.lang in mixing.TARGETS["lang"] else "*", r.topic] += r.n_tokens
    tokens = spark.createDataFrame([(*k, n) for k, n in cells.items()], "source string, lang string, topic string, tokens long")
    raked = mixing.raked(tokens, mixing.TARGETS, mixing.SWEEPS).collect()
    total = sum(cells.values())
    for d, targets in mixing.TARGETS.items():
        share = Counter()
        for r in raked:
            share[r[d]] += r.ratio * cells[r.source, r.lang, r.topic] / total
        assert all(share[k] == pytest.approx(v, abs=0.005) for k, v in targets.items()), (d, share)
    drawn = shares([r for r in got if r.kept], lambda r: r.lang if r.lang in mixing.TARGETS["lang"] else "*")
    before = shares(got, lambda r: r.lang if r.lang in mixing.TARGETS["lang"] else "*")
    away = lambda x: sum(abs(x.get(k, 0) - v) for k, v in mixing.TARGETS["lang"].items())
    assert away(drawn) < away(before) and away(drawn) < 0.2


def test_many_cells_are_joined_without_a_broadcast(docs, monkeypatch):
    want = sorted((r.doc_id or -1, r.text or "", r.p, r.kept) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "MOST_CELLS", 1)
    assert sorted((r.doc_id or -1, r.text or "", r.p, r.kept) for r in mixing.mix(docs).collect()) == want


def test_columns_that_clash_and_repeated_rows(spark, docs):
    """Mixing, language ID and PII replace their own columns, drop reserved ones and give equal rows equal results."""
    odd = docs.withColumns({c: F.lit("mine") for c in ("p", "topic", "n_tokens", "pii", "spans", "n_email", "lang_pred", "score", "_text", "_ratio")})
    model = language_id.train(docs)
    for out in (mixing.mix(odd), language_id.identify(odd, model), pii.find_pii(odd, digests=True)):
        rows = [(r.doc_id, r.text, repr(r)) for r in out.collect()]
        assert len(rows) == docs.count() and not any(c.startswith("_") for c in out.columns) and len(set(out.columns)) == len(out.columns)
        assert len({x for x in rows if x[0] == 3}) == 1 and sum(x[0] == 3 for x in rows) == 2
    row = pii.find_pii(odd, digests=True).first()
    assert isinstance(row.pii, list) and isinstance(row.n_email, int)


def test_very_long_texts(spark):
    rnd = random.Random(31)
    text = prose(rnd, 400_000) + " jane@example.com 192[.]168[.]1[.]1"
    df = spark.createDataFrame([(1, text, "aa"), (2, "kurz", "bb")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert [(s.kind, text[s.start : s.end]) for s in got[1].pii] == [("email", "jane@example.com"), ("ip", "192[.]168[.]1[.]1")] and got[2].pii == []
    assert {r.doc_id: r.lang_pred for r in language_id.identify(df, language_id.train(df)).collect()} == {1: "aa", 2: "bb"}


def test_ids_that_repeat_with_another_text(spark):
    """The row with the smaller hash of its text, or the smaller start, is the earlier one: one of the two keeps what they share."""
    shared = "\n".join(f"shared line {k} " + "x" * 60 for k in range(5))
    rows = [(7, f"{shared}\nfirst"), (7, f"{shared}\nsecond"), (8, f"third\n{shared}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.text.split("\n")[-1] if r.doc_id == 7 else "third": r.n_removed for r in line_dedup.line_dedup(df).collect()}
    assert sorted([got["first"], got["second"]]) == [0, 5] and got["third"] == 5
    cut = [(r.doc_id, r.n_removed) for r in suffix_dedup.repeated_strings(df).collect()]
    assert len(cut) == 3 and all(n >= len(shared) for i, n in cut if i == 8)


def naive_spans(text):
    """Base and added spans of one text, as the operator's parts give them, put together anew."""
    base = naive(text)
    added = pii.disguised(text, base)
    every = sorted([*base, *added])
    said = lambda xs: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in xs)
    return [sum(k == j for _, k, _ in base) for j in range(4)], hashlib.sha256(said(base).encode()).hexdigest(), said(every)


def test_pii_columns_against_the_patterns(spark):
    rnd = random.Random(32)
    pieces = ["a@b.cd", "x.y@d-e.org", "1.2.3.4", "255.255.255.256", "+49 (30) 123-456 78", "4111 1111 1111 1111", "jane [at] example [dot] com", "hello", "one two three", "10[.]0[.]0[.]1", "jоhn@example.com", "\U0001f600", "é"]
    texts = [rnd.choice([" ", ", ", "\n"]).join(rnd.choices(pieces, k=rnd.randrange(1, 9))) for _ in range(300)]
    got = pii.find_pii(spark.createDataFrame([(t,) for t in texts], "text string"), digests=True).collect()
    for r in got:
        counts, base, spans = naive_spans(r.text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts and r.base_sha256 == base and r.spans == spans
        found = {(s.kind, s.start, s.end) for s in r.pii}
        assert all(r.text[s.start : s.end].strip() == r.text[s.start : s.end] for s in r.pii) and len(found) == len(r.pii)
    # Every disguise that was planted is found where it stands, whole or by a base span within it, which stays.
    for r in got:
        for piece in ("jane [at] example [dot] com", "10[.]0[.]0[.]1", "jоhn@example.com"):
            for m in re.finditer(re.escape(piece), r.text):
                assert any(s.start < m.end() and m.start() < s.end for s in r.pii), (piece, r.text)


def test_bpe_round_trip(docs, empty):
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    keyed = docs.withColumn("row", F.monotonically_increasing_id()).cache()
    texts = {r.row: r.text or "" for r in keyed.collect()}
    got = byte_bpe.encode_and_decode(keyed, ranks, public_tokenizers.PATTERN).collect()
    assert sorted(r.row for r in got) == sorted(texts)
    for r in got:
        ids = plain.encode_ordinary(texts[r.row])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(texts[r.row].encode()).hexdigest()
    assert byte_bpe.encode_and_decode(empty, ranks, public_tokenizers.PATTERN).count() == 0


def test_numbering_of_a_block():
    rnd = random.Random(8)
    counts = Counter({f"w{k}": rnd.choice([1, 1, 1, 2, 3, 9, 70]) for k in range(3000)})
    words, bucket, first, sizes = byte_bpe._numbered(counts, 64)
    assert sorted(words) == sorted(counts)
    assert (byte_bpe._buckets_again(first, sizes, 64) == bucket).all()


def brute_classes(rows, threshold=0.8):
    bags = {i: Counter(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else Counter([tuple(w)]) if w else Counter() for i, t in rows for w in [re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())]}
    parent = {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(bags)
    for x in ids:
        for y in ids:
            if x < y and bags[x] and bags[y]:
                both = sum((bags[x] & bags[y]).values())
                if both / (sum(bags[x].values()) + sum(bags[y].values()) - both) >= threshold:
                    a, b = sorted((find(x), find(y)))
                    parent[b] = a
    return {i: find(i) for i in ids}


def test_near_duplicates(docs, empty):
    rows = [(i, t) for i, t in collected(docs) if i is not None and i != 2]
    want = brute_classes(rows)
    got = near_dedup.near_duplicates(docs.where("doc_id <> 2 OR doc_id IS NULL")).collect()
    assert len(got) == len(rows) + 1
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want and len(set(want.values())) < len(want)
    assert near_dedup.near_duplicates(docs).count() == docs.count()
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_in_a_large_bucket(spark):
    """Copies of one text with more and more words changed: leaders alone would not link them all."""
    rnd = random.Random(4)
    base = prose(rnd, 150).split()
    rows = [(k, " ".join(f"n{rnd.randrange(9)}" if rnd.random() < rnd.choice([0.005, 0.02, 0.05]) else w for w in base)) for k in range(120)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes(rows)
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)


def test_signatures_are_unbiased():
    """Slots agree with the probability of the weighted Jaccard similarity."""
    a, b = Counter({1: 5, 2: 1, 3: 2, 4: 1}), Counter({1: 2, 2: 1, 3: 2, 5: 3})
    want = sum((a & b).values()) / sum((a | b).values())
    agree = []
    for salt in range(40):
        arrays = [(textkit.mix(np.array(list(x), np.uint64) + np.uint64(1000 * salt)), np.array(list(x.values())), np.full(len(x), k)) for k, x in enumerate((a, b))]
        s = near_dedup.signatures(*(np.concatenate(c) for c in zip(*arrays)), 2)
        agree.append((s[0] == s[1]).mean())
    assert np.mean(agree) == pytest.approx(want, abs=0.03)


def brute_strings(rows, n=100):
    seen, out = {}, {}
    for i, t in sorted(rows, key=order):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            k = b[s : s + n]
            if seen.setdefault(k, (order((i,)), s)) < (order((i,)), s):
                gone[s : s + n] = b"\1" * n
        kept = bytes(x for x, y in zip(b, gone) if not y)
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_strings(docs, empty):
    some = docs.where("doc_id <> 2 OR doc_id IS NULL")
    got = suffix_dedup.repeated_strings(some).collect()
    assert len(got) == some.count()
    want = brute_strings(set(collected(some)))
    for r in got:
        assert (r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) == want[r.doc_id]
    assert suffix_dedup.repeated_strings(docs).count() == docs.count()
    assert suffix_dedup.repeated_strings(empty).count() == 0


def test_anchors_of_long_texts_in_pieces(monkeypatch):
    """Cut texts have the same starts in their blocks as whole ones."""
    rnd = random.Random(2)
    text = prose(rnd, 900)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array([text])], names=["_id", "_tag", "_text"])

    def starts(size):
        monkeypatch.setattr(suffix_dedup, "BYTES", size)
        out = []
        for b in suffix_dedup._anchors(iter([batch])):
            for at, n in zip(b.column("_at").to_pylist(), b.column("_n").to_pylist()):
                out += range(at >> suffix_dedup.TAG_BITS, (at >> suffix_dedup.TAG_BITS) + (n & suffix_dedup.N_MASK if n > 0 else -n))
        return sorted(out)

    assert starts(700) == starts(1 << 20) == list(range(len(text) - 99))


def test_language(spark, docs, empty):
    rnd = random.Random(1)
    parts = {"aa": ["the", "ing", "ion", "and"], "bb": ["der", "sch", "ung", "ein"], "cc": ["ción", "que", "los", "ñar"]}
    make = lambda lang: " ".join("".join(rnd.choices(parts[lang], k=rnd.randrange(1, 4))) for _ in range(30))
    rows = [(k, make(lang), lang) for k in range(600) for lang in [rnd.choice(list(parts))]]
    every = spark.createDataFrame(rows + [(9001, None, None), (9002, "12 34 !!", None), (9003, "", "aa")], "doc_id long, text string, lang string")
    model = language_id.train(every.where(~language_id.held_out()))
    got = language_id.identify(every.select("doc_id", "text", F.lit("x").alias("lang_pred")), model).collect()
    by_id = {r.doc_id: r for r in got}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (9001, 9002, 9003))
    assert np.mean([by_id[i].lang_pred == lang for i, _, lang in rows]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    none = language_id.identify(docs, language_id.train(empty)).collect()
    assert len(none) == docs.count() and {r.lang_pred for r in none} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def _plain_grams(text):
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    return {low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1)}


def test_kernel_counts_shared_ngrams():
    a, b = "abc abd", "abd xyz"
    model = language_id.fit([("x", a), ("y", b)])
    k, letter = language_id.kernel([a, b, "12"], model)
    want = len(_plain_grams(a) & _plain_grams(b)) / np.sqrt(len(_plain_grams(a)) * len(_plain_grams(b)))
    assert k[0, 1] == pytest.approx(want) and k[0, 0] == pytest.approx(1) and letter.tolist() == [True, True, False]


def brute_ridge(rows, texts):
    """Kernel ridge regression through landmarks, one against the rest, on sets of n-grams as they are."""
    languages = sorted({x for x, _ in rows})
    marks = [_plain_grams(t) for lang in languages for t in [t for x, t in rows if x == lang][: language_id.LANDMARKS]]
    known = set().union(*marks)
    k = lambda s, m: len(s & m) / np.sqrt(max(1, len(s & known)) * len(m))
    k_nm = np.array([[k(_plain_grams(t), m) for m in marks] for _, t in rows])
    k_mm = np.array([[k(s, m) for m in marks] for s in marks])
    w = np.diag([1 / sum(z == x for z, _ in rows) for x, _ in rows])
    y = np.array([[1.0 if x == lang else -1.0 for lang in languages] for x, _ in rows])
    alpha = np.linalg.lstsq(k_nm.T @ w @ k_nm + language_id.RIDGE * (k_mm + 1e-6 * np.eye(len(marks))), k_nm.T @ w @ y, rcond=None)[0]
    return [languages[i] for i in (np.array([[k(_plain_grams(t), m) for m in marks] for t in texts]) @ alpha).argmax(1)]


def syllables(rnd, script, n):
    return " ".join("".join(rnd.choices(script, k=rnd.randrange(1, 4))) for _ in range(n))


def test_predictions_equal_brute_force(spark):
    rnd = random.Random(11)
    parts = {"aa": ["the", "ing", "ion", "and", "sch"], "bb": ["der", "sch", "ung", "ein", "the"], "cc": ["ción", "que", "los", "ing"]}
    rows = [(lang, syllables(rnd, parts[lang], 20)) for lang in parts for _ in range(40)]
    texts = [syllables(rnd, parts[rnd.choice(list(parts))], rnd.randrange(1, 12)) for _ in range(200)] + ["", "a", "zzz"]
    model = language_id.fit(rows)
    got = language_id.identify(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()
    want = dict(zip(texts, brute_ridge(rows, texts)))
    assert all(r.lang_pred == (want[r.text] if r.text else "und") for r in got)


def test_languages_with_long_texts_only_and_many_languages(spark):
    rnd = random.Random(12)
    alphabets = [[chr(base + k) for k in range(20)] for base in (0x61, 0x3B1, 0x430, 0x5D0, 0x627, 0x905, 0xE01, 0x4E00, 0xAC00, 0x10D0)]
    script = {f"l{k}": ["".join(rnd.choices(alphabets[k % 10], k=rnd.randrange(2, 4))) for _ in range(6)] for k in range(100)}
    rows = [(k, syllables(rnd, script[lang], 4000 if lang == "l7" else 30), lang) for k in range(2000) for lang in [f"l{k % 100}"]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df.where(~language_id.held_out()))
    assert len(model.languages) == 100
    got = language_id.identify(df.where(language_id.held_out()), model).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95 and all(r.lang_pred == "l7" for r in got if r.lang == "l7")


def test_the_sample_does_not_depend_on_the_order(spark):
    rnd = random.Random(13)
    parts = {"aa": ["the", "ing"], "bb": ["der", "sch"]}
    rows = [(None if k % 3 else 5, syllables(rnd, parts[lang], 8), lang) for k in range(400) for lang in [rnd.choice(["aa", "bb"])]]
    df = spark.createDataFrame(rows + rows[:50], "doc_id long, text string, lang string")
    names = {language_id.train(df.repartition(n)).name for n in (1, 3, 7)}
    assert len(names) == 1


def naive(text):
    out = []
    for k, p in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 12 <= len(d) <= 19 and pii.luhn(d) or k == 3 and 9 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_plain_identifiers_against_the_patterns():
    rnd = random.Random(6)
    pieces = ["a@b.c", "@", ".", "x_y%z", "1.2.3.4", "255", "256", "+1 (555) 010-9999", "4111 1111 1111 1111", "4111-1111", " ", "-", "é", "5", "0", "..", "+", "@d.e-f.g", "\n"]
    for _ in range(3000):
        t = "".join(rnd.choices(pieces, k=rnd.randrange(1, 14)))
        assert pii.plain(t) == naive(t), t


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"), ("jane at example dot com, ok", "email", "jane at example dot com"), ("jаne@exаmple.com", "email", "jаne@exаmple.com"),
        ("x @ example.com y", "email", "x @ example.com"), ("call plus four nine three zero one two three four five six seven eight", "phone", "plus four nine three zero one two three four five six seven eight"),
        ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("at one nine two dot one six eight dot one dot one end", "ip", "one nine two dot one six eight dot one dot one"), ("j​o@ex​ample.com", "email", "j​o@ex​ample.com"),
    ],
)
def test_disguises(text, kind, span):
    found = pii.disguised(text, pii.plain(text))
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in found] == [(kind, span)]


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("host 192[.]168[.]1[.]1 up", "ip", "192[.]168[.]1[.]1"), ("host 192[dot]168[dot]1[dot]1 up", "ip", "192[dot]168[dot]1[dot]1"), ("host 192 dot 168 dot 1 dot 1 up", "ip", "192 dot 168 dot 1 dot 1"),
        ("mail jane at example [dot] com now", "email", "jane at example [dot] com"), ("mail bo at firma dot se now", "email", "bo at firma dot se"), ("mail ola at firma dot no now", "email", "ola at firma dot no"),
    ],
)
def test_disguises_without_an_at_sign(text, kind, span):
    found = pii.disguised(text, pii.plain(text))
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in found] == [(kind, span)]


@pytest.mark.parametrize("text", ["look at the dot is it red", "see more at example.com today", "look at this dot to the left"])
def test_running_text_is_no_address(text):
    assert pii.disguised(text, pii.plain(text)) == []


@pytest.mark.parametrize("text", ["look at the dot on the map", "one two three go", "plain words only", "a @ b", "five or six, maybe seven", "42.144.35.254 and a@b.org"])
def test_nothing_is_added_to_clean_texts(text):
    assert pii.disguised(text, pii.plain(text)) == []


def test_pii_query_columns(docs, empty):
    got = pii.find_pii(docs, digests=True).collect()
    assert len(got) == docs.count()
    assert {r.base_sha256 for r in got if not r.pii} <= {hashlib.sha256(b"").hexdigest()}
    assert pii.find_pii(empty).count() == 0


def test_passages(docs, empty):
    got = passage_dedup.repeated_passages(docs).collect()
    words = {i: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower()) for i, t in collected(docs) if i != 2}
    seen, want = {}, set()
    for i in sorted(i for i in words if i is not None):
        runs = {tuple(words[i][k : k + 50]) for k in range(len(words[i]) - 49)}
        if any(seen.get(r, i) != i for r in runs):
            want.add(i)
        for r in runs:
            seen.setdefault(r, i)
    found = {r.doc_id for r in got}
    assert want <= found and found - want <= {15}
    for r in got:
        assert r.source_doc_id < r.doc_id and r.similarity >= 0.8 and r.end_word - r.start_word >= 50
    assert passage_dedup.repeated_passages(empty).count() == 0


def test_passage_with_changes(spark):
    rnd = random.Random(9)
    passage = prose(rnd, 120).split()
    changed = ["changed" if k == 60 else w for k, w in enumerate(passage)]
    rows = [(1, f"{prose(rnd, 80)} {' '.join(passage)} {prose(rnd, 50)}"), (2, f"{prose(rnd, 40)} {' '.join(changed)} {prose(rnd, 90)}"), (3, prose(rnd, 300))]
    got = passage_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.source_doc_id) for r in got} == {(2, 1)}
    assert any(r.start_word <= 45 and r.end_word >= 155 for r in got)


@pytest.mark.parametrize("fragment", [0, 10, 20, 30])
def test_changed_passages_behind_fragments(spark, fragment):
    """Pairs of passages with one word changed, parts of which earlier documents hold: found whatever these are, at any split."""
    rnd = random.Random(20 + fragment)
    rows, want = [], set()
    for k in range(50):
        passage = prose(rnd, 60, 5000).split()
        at = rnd.randrange(61 - fragment)
        rows += [(1000 * e + k, f"{prose(rnd, 70, 5000)} {' '.join(passage[at : at + fragment])} {prose(rnd, 70, 5000)}") for e in (0, 1)]
        changed = list(passage)
        changed[rnd.randrange(60)] = "changed"
        a, b = (Counter(zip(*(x[i:] for i in range(5)))) for x in (passage, changed))
        if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
            want.add((5000 + k, 2000 + k))
        rows += [(i, f"{prose(rnd, 50, 5000)} {' '.join(x)} {prose(rnd, 50, 5000)}") for i, x in ((2000 + k, passage), (5000 + k, changed))]
    got = [sorted(tuple(r) for r in passage_dedup.repeated_passages(spark.createDataFrame(spark.sparkContext.parallelize(rnd.sample(rows, len(rows)), parts), "doc_id long, text string")).collect()) for parts in (1, 5)]
    assert got[0] == got[1]
    found = {(r[0], r[3]) for r in got[0]}
    assert len(want) >= 45 and len(want & found) >= 0.9 * len(want), len(want & found) / len(want)
    assert found <= want | {(5000 + k, 2000 + k) for k in range(50)}


def test_passages_of_groups_without_cap(spark, monkeypatch):
    """Links are found whatever earlier documents hold the same words, in groups of any size and however these are dealt."""
    rnd = random.Random(31)
    rows, want = [], set()
    for k in range(30):  # both halves of each passage are in earlier documents, which are close to nothing
        passage = prose(rnd, 60, 5000).split()
        rows += [(1000 * e + k, f"{prose(rnd, 70, 5000)} {' '.join(part)} {prose(rnd, 70, 5000)}") for e, part in enumerate((passage[:40], passage[20:]))]
        changed = list(passage)
        changed[rnd.choice([1, 2, 57, 58])] = "changed"
        rows += [(i, f"{prose(rnd, 50, 5000)} {' '.join(x)} {prose(rnd, 50, 5000)}") for i, x in ((2000 + k, passage), (5000 + k, changed))]
        want.add((5000 + k, 2000 + k))
    line = prose(rnd, 30, 5000)
    rows += [(10000 + k, f"{prose(rnd, 40, 5000)} {line} {prose(rnd, 40, 5000)}") for k in range(300)]
    for k in range(20):  # a passage around the line, with a word put in
        before, after = prose(rnd, 15, 5000), prose(rnd, 15, 5000).split()
        rows += [(11000 + 10 * k + c, f"{prose(rnd, 30, 5000)} {before} {line} {' '.join(x)} {prose(rnd, 30, 5000)}") for c, x in enumerate((after, after[:11] + ["more"] + after[11:]))]
        want.add((11001 + 10 * k, 11000 + 10 * k))
    base = prose(rnd, 70, 5000).split()  # near copies: each is linked to an earlier one
    near = []
    for k in range(60):
        x = list(base)
        x[rnd.randrange(70)] = f"new{k}"
        near.append(20000 + k)
        rows.append((20000 + k, " ".join(x)))
    got = []
    for parts, chunk in ((1, passage_dedup.CHUNK), (5, 64)):
        monkeypatch.setattr(passage_dedup, "CHUNK", chunk)
        df = spark.createDataFrame(spark.sparkContext.parallelize(rnd.sample(rows, len(rows)), parts), "doc_id long, text string")
        got.append({(r.doc_id, r.source_doc_id) for r in passage_dedup.repeated_passages(df).collect()})
    for found in got:
        assert want <= found, want - found
        pairs = [(a, b) for b, a in found if b >= 20000]
        label = {i: i for i in near}
        for a, b in sorted(pairs, key=lambda p: (p[1], p[0])):
            old, to = label[b], label[a]
            label = {i: to if c == old else c for i, c in label.items()}
        assert set(label.values()) == {20000}
        assert {b for _, b in pairs} == set(near[1:])
        assert all(b >= 20000 and a >= 20000 for b, a in found - want)


def test_runs_of_one_word(spark):
    """Texts that repeat one word are linked whatever the lengths of the runs."""
    rnd = random.Random(6)
    rows = [(k, f"{prose(rnd, 60, 5000)} {'spam ' * n} {prose(rnd, 60, 5000)}") for k, n in enumerate((120, 60, 200, 400))]
    got = passage_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {1, 2, 3}


def test_forest_equals_brute_force():
    """Components by blocks are those of all pairs, with and without sides; words put in or left out are no obstacle."""
    rng = np.random.default_rng(5)
    base, rows = rng.integers(0, 1 << 16, (5, 140)), []
    for k in range(600):
        y = list(base[k % 5]) if k % 3 else list(rng.integers(0, 1 << 16, 140))
        y[55:80] = base[0][55:80]  # everyone shares 25 tokens
        if k % 3 == 1:
            at = rng.integers(30, 100)
            y[at : at + 5 * rng.integers(0, 4)] = rng.integers(0, 1 << 16, rng.integers(0, 10)).tolist()
        at = y.index(base[0][66]) if base[0][66] in y else 66
        part = y[max(at - 45, 0) : at + 46]
        rows.append([-1] * max(0, 45 - at) + part + [-1] * (91 - len(part) - max(0, 45 - at)))
    x, ids, side = np.array(rows, np.int32), np.arange(600) // 2, np.arange(600) % 2
    for s in (None, side):
        v, u = np.nonzero((ids[:, None] > ids[None, :]) & ((s is None) | (side[:, None] != side[None, :])))
        on = passage_dedup._linked(x, u, v, 0.8)
        links = passage_dedup._forest(x, ids, s, 0.8)
        label = [np.arange(600), np.arange(600)]
        for n, edges in enumerate((links, zip(u[on], v[on]))):
            for a, b in edges:
                label[n][label[n] == label[n][max(a, b)]] = label[n][min(a, b)]
        same = [x[:, None] == x[None, :] for x in label]
        assert (same[0] == same[1]).all() and 5 < len(set(label[0])) < 500
        assert set(links) <= set(zip(u[on].tolist(), v[on].tolist()))


def test_forest_leaves_out_what_cannot_be_linked(monkeypatch):
    """Runs of one word that are too short for a passage and share nothing else are not tested pair by pair; longer ones are linked."""
    rng, tested, real = np.random.default_rng(7), [0], passage_dedup._has_passage

    def counted(found, share):
        tested[0] += len(found)
        return real(found, share)

    monkeypatch.setattr(passage_dedup, "_has_passage", counted)
    for run, links in ((43, 0), (60, 399)):
        x = np.empty((400, 91), np.int32)
        for k, row in enumerate(x):
            at = int(rng.integers(max(0, 46 - run), 32 if run > 46 else 45))
            row[:] = 9
            row[:at], row[at + run :] = 100 + 2 * k, 101 + 2 * k
        tested[0] = 0
        found = passage_dedup._forest(x, np.arange(400), None, 0.8)
        assert len(found) == links and tested[0] < 20 * 400, (run, len(found), tested)
        u, v = np.triu_indices(60, 1)
        assert passage_dedup._linked(x, u, v, 0.8).all() == bool(links)


def test_passage_twice_in_one_document(spark):
    """Both places are whole, wherever the earlier copy lies."""
    rnd = random.Random(10)
    passage = prose(rnd, 600, 4000)
    rows = [(1, f"{prose(rnd, 80)} {passage}"), (2, f"{prose(rnd, 60)} {passage} {prose(rnd, 70)} {passage} {prose(rnd, 50)}")]
    for parts in (2, 1):
        df = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string")
        got = passage_dedup.repeated_passages(df).collect()
        covered = {w for r in got if r.doc_id == 2 for w in range(r.start_word, r.end_word)}
        assert covered >= {*range(60, 660), *range(730, 1330)}


def test_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 16))
    x[50:80] = x[49] + rng.standard_normal((30, 16)) * 0.05
    x[100:110] = x[99]
    x[150] = 0
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 16), (303, [1.0, 2.0]), (304, [])]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<double>, n_links int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    m = u @ u.T >= 0.9
    np.fill_diagonal(m, False)
    m[150] = m[:, 150] = False
    recall = sum(got[i].n_links for i in range(300)) / m.sum()
    assert 0.9 <= recall <= 1
    label = embedding_dedup._forest(m)
    assert [got[i].component_id for i in range(300)] == label.tolist()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (150, 300, 301, 302, 303, 304))
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_vectors_of_all_kinds(spark):
    """Two lengths, extreme magnitudes, repeated and null ids, all against brute force over the rows."""
    rng = np.random.default_rng(7)
    rows = []
    for d, n in ((16, 120), (2, 40)):
        x = rng.standard_normal((n, d))
        x[n // 2 :] = x[: n - n // 2] + 0.1 * rng.standard_normal((n - n // 2, d))
        rows += [(1000 * d + k, v) for k, v in enumerate(x)]
    rows += [(1, np.array([1e-200, 0.0])), (2, np.array([1e200, 0.0])), (3, np.array([1e200, 1e200])), (4, np.array([5e-324, 5e-324])), (7, np.eye(16)[0]), (7, np.eye(16)[1]), (8, np.eye(16)[0]), (None, np.eye(16)[2]), (None, np.eye(16)[3]), (9, np.eye(16)[3]), (None, np.eye(16)[2])]
    unit = [v / np.abs(v).max() for _, v in rows]
    unit = [v / np.linalg.norm(v) for v in unit]
    linked = np.array([[i != j and len(a) == len(b) and a @ b >= 0.9 for j, b in enumerate(unit)] for i, a in enumerate(unit)])
    label = embedding_dedup._forest(linked)
    names = {c: min((rows[i][0] for i in np.flatnonzero(label == c) if rows[i][0] is not None), default=None) for c in set(label)}
    df = spark.createDataFrame([(i, v.tolist(), k) for k, (i, v) in enumerate(rows)], "vec_id long, embedding array<double>, place int")
    got = {r.place: r for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    assert len(got) == len(rows)
    found = sum(got[k].n_links for k in range(len(rows)))
    assert all(got[k].n_links <= linked[k].sum() for k in got) and found >= 0.98 * linked.sum()
    assert all(got[k].component_id == names[label[k]] and got[k].kept == (rows[k][0] == names[label[k]]) for k in range(len(rows) - 11, len(rows)))
    assert [got[k].n_links for k in range(len(rows) - 7, len(rows))] == [1, 0, 1, 1, 1, 1, 1]


def test_vectors_of_a_dense_group(spark):
    """A third of the rows are near copies of one vector: their pairs are found like any other."""
    rng = np.random.default_rng(4)
    n, d = 6000, 64
    x = rng.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[: n // 3] = np.sqrt(0.9) * x[0] + np.sqrt(0.1 / d) * rng.standard_normal((n // 3, d))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    m = u @ u.T >= 0.9
    np.fill_diagonal(m, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    links = m.sum(1)
    assert all(got[i] <= links[i] for i in range(n))
    assert sum(got.values()) / links.sum() >= 0.99


def test_index_recall_at_the_threshold():
    """Pairs of random vectors at cosine 0.9 exactly share enough pivots in nine of ten cases at least."""
    rng = np.random.default_rng(1)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    for pivots in (64, 512):
        p, a = unit(rng.standard_normal((pivots, 64))), unit(rng.standard_normal((1000, 64)))
        r = rng.standard_normal(a.shape)
        r = unit(r - (r * a).sum(1, keepdims=True) * a)
        b = 0.9 * a + np.sqrt(1 - 0.81) * r
        near = [np.argsort(-(v @ p.T), 1)[:, : embedding_dedup.PREFIX] for v in (a, b)]
        shared = (near[0][:, :, None] == near[1][:, None, :]).sum((1, 2))
        assert (shared >= embedding_dedup.SHARED).mean() >= 0.9


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1060)] + [(None, 3), (5, 5)]
    parent = {x: x for p in pairs for x in p if x is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(find(x) == c for x, c in got.items()) and set(got) >= {x for p in pairs if None not in p and p[0] != p[1] for x in p}
