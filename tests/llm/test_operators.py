"""Each operator against brute force on a small fixture with nulls, empty and long texts, ties, repeated rows and extra columns."""

import datetime
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
from pyspark.sql import functions as F

from plumbline.llm import ann, bpe, langid, licenses, media, neardup, packing, pii, toxicity, warc

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SCHEMA = "doc_id long, text string, lang string, source string, ids string, score double, pii string, toxicity double, lang_pred string, h long"


def low(t):
    return (t or "").encode().translate(LOWER).decode()


def texts():
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta", "été", "Ünder", "naïve", "12", "x9", "don't", "the", "of", "License", "to"]
    out = [None, "", " ", "\n\t", "one", "a" * 3000, "Same text here for all of you now", "Same text here for all of you now", "日本語 テキスト", "a\x1cb c  d e", "<|endoftext|> mid <|startoftext|>x"]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(4)]
    for b in base:
        w = b.split()
        for _ in range(6):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = rng.choice(words)
            out.append(" ".join(v))
    out += ["Released Under the MIT License. under the mit license", "Apache License, Version 2.0 cc-by-nc cc by  NC", "cc by nc cc by nc", " ".join(words * 2000)]
    return out


def frame(spark, rows=None):
    data = [(i, t, "en", "s", "x", 0.5, "p", 0.1, "zz", 1) for i, t in enumerate(texts())] if rows is None else rows
    if rows is None:
        data += [(3, texts()[3], "en", "s", "x", 0.5, "p", 0.1, "zz", 1), (None, "no id", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA).repartition(3) if data else spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    from pathlib import Path
    import tempfile

    path = f"{tempfile.mkdtemp()}/documents.parquet"
    frame(spark).write.parquet(path)
    assert Path(path).exists()
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def test_bpe_equals_the_library(docs, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = bpe.digests(bpe.decode(bpe.encode(docs, path), path)).collect()
    want = []
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encode(empty, path).count() == 0


def test_bpe_on_random_strings():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t, m, rng = Tokenizer.from_file(path), bpe.load(path), random.Random(2)
    import pyarrow as pa

    parts = [" ", "a", "th", "ing", "'s", "'", "!", "</", "w>", "é", "Σ", "İ", "1", "́", "日本", "<|endoftext|>", "\x1c", " ", "😀"]
    tx = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(800)] + ["ab" * 3000]
    ids, at = m.encode_batch(pa.array(tx))
    for k, x in enumerate(tx):
        assert t.encode(x, add_special_tokens=False).ids == ids[at[k] : at[k + 1]].tolist(), x


def brute_components(rows, k, num=80, den=100):
    W = re.compile(r"[^\x20\x09-\x0D]+")
    sets = {}
    for i, t in rows:
        w = W.findall(low(t))
        sets.setdefault(i, []).append(frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset())
    ids, par = sorted(sets), {i: i for i in sets}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(s and t and den * len(s & t) >= num * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = sorted((find(a), find(b)))
                par[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, empty, k):
    got = neardup.near_duplicates(docs, k).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_components([r for r in rows if r[0] is not None], k)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is None or r.component_id == r.doc_id)
    assert neardup.near_duplicates(empty, k).count() == 0


def test_near_duplicates_of_a_chain_need_more_than_one_centre(spark):
    """Each text is near its neighbours only, so links lead from one end to the other."""
    w = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(w[4 * i : 4 * i + 60])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 4)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 4).collect()} == want


@pytest.mark.parametrize("rows_a_block, shingles_a_block", [(1024, 1 << 22), (8, 1 << 22), (1024, 300)])
@pytest.mark.parametrize("changed", [2, 4, 8])
def test_large_groups_meet_in_blocks(spark, monkeypatch, rows_a_block, shingles_a_block, changed):
    """Copies of one text at similarities about the threshold; whole groups, groups cut by rows and by shingles."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", rows_a_block)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", shingles_a_block)
    rng = random.Random(changed)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(40):
        v = list(base)
        for j in rng.sample(range(120), changed):
            v[j] = f"z{i}-{j}"
        rows.append((i, " ".join(v)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 4)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 4).collect()} == want


def test_very_many_pairs_are_confirmed_by_products():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 100).astype(np.uint64)
    sets = []
    for i in range(60):
        s = base.copy()
        s[rng.choice(100, 3 + i % 12, replace=False)] = rng.integers(0, 1 << 63, 3 + i % 12).astype(np.uint64)
        sets.append(np.unique(s))
    a, b = np.triu_indices(60, 1)
    ok = [80 * len(np.union1d(sets[i], sets[j])) <= 100 * len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)]
    want = neardup.roots_of(60, a[ok], b[ok])
    apart = rng.integers(0, 40, len(a))
    assert 1 < len(set(want.tolist())) < 60
    assert neardup.confirmed(sets, a, b, apart, 80, 100).tolist() == want.tolist()
    few = rng.permutation(len(a))[:300]  # one by one
    few.sort()
    sub = np.array(ok)[few]
    assert neardup.confirmed(sets, a[few], b[few], apart[few], 80, 100).tolist() == neardup.roots_of(60, a[few][sub], b[few][sub]).tolist()


def test_near_duplicates_with_string_ids_and_repeated_ids(spark):
    base = [f"w{i}" for i in range(80)]
    other = [f"u{i}" for i in range(80)]
    rows = [("a", " ".join(base)), ("b", " ".join([*base[:79], "x"])), ("b", " ".join(other)), ("c/d", " ".join(["y", *other[1:]])), ("e", " ".join(other)), ("f", None), ("", "one two")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(docs, 4).collect())
    assert got == sorted([("a", "a"), ("b", "a"), ("b", "a"), ("c/d", "a"), ("e", "a"), ("f", "f"), ("", "")])


def test_words_across_parts(monkeypatch):
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("abcXYZ", k=rng.choice([1, 3, 9, 70]))) for _ in range(400)) + "  \t end"
    words = [w.lower() for w in text.split()]
    whole = neardup.word_hashes(text)
    monkeypatch.setattr(neardup, "PART", 50)
    monkeypatch.setattr(neardup, "_powers", [])
    parts = neardup.word_hashes(text)
    assert len(whole) == len(parts) == len(words)
    short = [i for i, w in enumerate(words) if len(w) < 50]
    assert whole[short].tolist() == parts[short].tolist()
    for h in (whole, parts):
        assert len(set(h.tolist())) == len(set(words))
        assert {w: x for w, x in zip(words, h.tolist())} == dict(reversed([*zip(words, h.tolist())]))


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    for n in (5, 60, 800):
        gaps = []
        for _ in range(60):
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            b = a.copy()
            b[: max(1, n // 4)] = rng.integers(0, 1 << 63, max(1, n // 4))
            m = max(1, n // 4)
            gaps.append((neardup.sketch(a) == neardup.sketch(b)).mean() - (n - m) / (n + m))
        assert abs(np.mean(gaps)) < 0.03 and np.std(gaps) < 0.06


def test_language(spark, empty):
    en, fr = "the of and to in that with this from for".split(), "le la les des une avec pour dans être élan".split()
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(en if i % 2 else fr) for _ in range(30)), "en" if i % 2 else "fr", *[None] * 7) for i in range(200)]
    rows += [(900, None, "en", *[None] * 7), (901, "", "en", *[None] * 7), (902, "12 34 !!", None, *[None] * 7), (903, "the " * 50_000, None, *[None] * 7)]
    docs = frame(spark, rows)
    model = langid.train(docs, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    held = [i for i in range(200) if i % 4 == 2]
    assert np.mean([got[i].lang_pred == ("en" if i % 2 else "fr") for i in held]) > 0.95
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(empty, langid.train(empty, F.lit(True))).count() == 0
    assert (model.w == 0).mean() > 0.5  # sparse


KEY = "k"


def twin_hash(*parts):
    return hashlib.sha256("|".join(str(p) for p in parts).encode()).hexdigest()


def twin_permute(x, p, q, tweak):
    a, b = divmod(x, q)
    for i in range(1, pii.ROUNDS // 2 + 1):
        a = (a + int(twin_hash(KEY, tweak, p, q, "a", i, b)[:14], 16)) % p
        b = (b + int(twin_hash(KEY, tweak, p, q, "b", i, a)[:14], 16)) % q
    return a * q + b


def twin_shifted(c, by):
    for first, size in ((48, 10), (97, 26), (65, 26)):
        if first <= c < first + size:
            return (c - first + by) % size + first
    beyond = 0xC0 <= c <= 0xFFFF and not 0xD7C0 <= c <= 0xDFFF and not 0x2000 <= c <= 0x2BFF and not 0x3000 <= c <= 0x303F
    return c // 64 * 64 + (c + by) % 64 if beyond else c


def twin_scrambled(s, kind):
    c = [ord(x) for x in s]
    half = (len(c) + 1) // 2
    a, b = c[:half], c[half:]
    for i in range(1, pii.ROUNDS + 1):
        seed = twin_hash(KEY, kind, i, ",".join(map(str, b)))
        stream = "".join(twin_hash(seed, k) for k in range(len(a) // pii.BLOCK + 1))
        a, b = b, [twin_shifted(x, int(stream[4 * j : 4 * j + 4], 16)) for j, x in enumerate(a)]
    return "".join(map(chr, a + b))


def twin_digits(n, x, tweak):
    return str(twin_permute(int(x), 10 ** (n - n // 2), 10 ** (n // 2), tweak)).zfill(n)


def twin_refill(layout, new):
    new = iter(new)
    return "".join(next(new) if c.isdigit() else c for c in layout)


def luhn(d, odd=0):
    return sum(int(c) if (k + odd) % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d)))


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def twin(m):
    """(pseudonym, kind) of a match, in plain Python."""
    d = re.sub(r"[^0-9]", "", m)
    if "@" in m:
        a, _, b = m.partition("@")
        return f"{twin_scrambled(a, 'mailbox')}@{twin_scrambled(b.lower(), 'domain')}.example", "email"
    if regex.match(pii._SECRET, m):
        name = re.match(r"[^=:]+[=:][ \t]*[\"']?", m)[0]
        return name + twin_scrambled(m[len(name) :], "secret"), "secret"
    if regex.fullmatch(pii._IP, m):
        x = twin_permute(int.from_bytes(bytes(map(int, m.split(".")))), 1 << 16, 1 << 16, "ip")
        return ".".join(map(str, x.to_bytes(4))), "ip"
    if regex.fullmatch(pii._DATE, m):
        for f in ("%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%d.%m.%Y"):
            try:
                day = datetime.datetime.strptime(m, f).date()
            except ValueError:
                continue
            if 1900 <= day.year <= 2099:
                first = datetime.date(1900, 1, 1)
                return (first + datetime.timedelta(twin_permute((day - first).days, 4297, 17, "date"))).strftime(f), "date"
            break
    if regex.fullmatch(pii._SSN, m) and not re.match("000|666|9", m) and not re.search("-00-|-0000$", m):
        a, g, s = map(int, m.split("-"))
        x = twin_permute(((a - (2 if a > 666 else 1)) * 99 + g - 1) * 9999 + s - 1, 898 * 99, 9999, "ssn")
        a = x // (99 * 9999)
        return f"{a + (2 if a >= 665 else 1):03d}-{x // 9999 % 99 + 1:02d}-{x % 9999 + 1:04d}", "ssn"
    if re.fullmatch(r"[0-9][0-9 \-]+", m) and 13 <= len(d) <= 19 and luhn(d) % 10 == 0 and d.strip("0"):
        body = twin_digits(len(d) - 1, d[:-1], "card")
        return twin_refill(m, body + str(-luhn(body, 1) % 10)), "card"
    s = m.replace(" ", "")
    if regex.fullmatch(pii._IBAN, m) and 15 <= len(s) <= 34 and mod97(s[4:] + s[:4]) == 1:
        account = twin_scrambled(s[4:], "iban")
        new = iter(s[:2] + f"{98 - mod97(account + s[:2] + '00'):02d}" + account)
        return "".join(c if c == " " else next(new) for c in m), "iban"
    if regex.fullmatch(pii._PHONE, m):
        n = min(len(d), 10)
        return twin_refill(m, d[: len(d) - n] + twin_digits(n, d[len(d) - n :], "phone")), "phone"
    return m, None


def twin_rewritten(text):
    kinds = []

    def one(found):
        new, kind = twin(found[0])
        if new != found[0]:
            kinds.append(kind)
        return new

    return regex.sub(pii.ANY, one, text), kinds


PRIVATE = [
    "card 4012-8888 8888 1881 and 4012888888881881.",
    "ip 10.0.0.1, mail a.b@c.example.com! +1 (017) 555-7713",
    'token = "0123456789abcdef0123"',
    "born 2001-02-03, 12/31/1999 or 31.12.1999; not 2001-02-31",
    "ssn 078-05-1120 not 666-05-1120",
    "iban GB82 WEST 1234 5698 7654 32 and DE89370400440532013000",
    "1.2.3.4.5 4012888888881882 v1.2",
    "plain text " * 5000,
    "10.0.0.1 10.0.0.1",
    "Zoë.Ünal+x@a.b.c.d.e.f.g.h.i.j.secretcorp.example.com and x@y.zz",
    "access_token=Zyxwvuts9 client_secret = Zyxwvuts9",
    "a@b.co A@B.co q@" + "l." * 3000 + "com",
    "",
]


def test_pii_equals_its_twin(spark, docs, empty):
    more = [r.text for r in docs.select("text").collect()]
    rows = [*PRIVATE, None, *more]
    given = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("pii", F.lit("clash"))
    got = {r.doc_id: r for r in pii.pseudonymise(given, KEY).collect()}
    for i, text in enumerate(rows):
        if text is None:
            assert got[i].text is None and got[i].pii is None
        else:
            assert (got[i].text, got[i].pii) == twin_rewritten(text), text[:200]
    assert pii.describe(empty, KEY).count() == 0
    out = [got[i].text for i in range(len(PRIVATE))]
    a, b = re.fullmatch(r"card (\d{4}-\d{4} \d{4} \d{4}) and (\d{16})\.", out[0]).groups()
    assert re.sub(r"\D", "", a) == b != "4012888888881881" and luhn(b) % 10 == 0
    assert "secretcorp" not in out[9] and "l.l.l" not in out[11]
    for iban in re.findall(r"[A-Z]{2}\d\d[A-Z0-9 ]{11,}(?= and|$)", out[5]):
        assert mod97(iban.replace(" ", "")[4:] + iban[:4]) == 1


def test_a_key_is_needed(docs):
    with pytest.raises(ValueError):
        pii.pseudonymise(docs, "")


@pytest.mark.parametrize("n", [512, 513, 800, 200_000])
def test_long_secrets_are_replaced_whole(spark, n):
    value = "".join(random.Random(n).choices("GHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz", k=n - 1)) + "Z"
    rows = [f"a token={value} b", f"c token={value}", f"d token={value[:-1]}Y"]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), KEY).orderBy("doc_id").collect()]
    new = re.fullmatch(rf"a token=([A-Za-z]{{{n}}}) b", got[0])[1]
    assert got[1] == f"c token={new}" and got[2] != f"d token={new}" and new == twin_scrambled(value, "secret")
    assert sum(a == b for a, b in zip(new, value, strict=True)) < 0.1 * n


def test_secrets_of_joined_and_quoted_names(spark):
    rows = ["access_token=Zyxwvuts9", "client_secret = Zyxwvuts9", "DB_PASSWORD=Zyxwvuts9", "SECRET_KEY='Zyxwvuts9'", '{"password": "Zyxwvuts9"}', "'my-api-key' : 'Zyxwvuts9'", "dbPassword: Zyxwvuts9", "AWS_SECRET_ACCESS_KEY=Zyxwvuts9"]
    plain = ["tokens=Zyxwvuts9", "xtoken=Zyxwvuts9", "token=Zyx", "a secret shared by Zyxwvuts9", "password_hint=Zyxwvuts9"]
    docs = spark.createDataFrame(list(enumerate(rows + plain)), "doc_id long, text string")
    got = pii.pseudonymise(docs, KEY).orderBy("doc_id").collect()
    for was, r in zip(rows, got, strict=False):
        assert r.pii == ["secret"] and re.fullmatch(re.escape(was).replace("Zyxwvuts9", "[A-Z][a-z]{7}[0-9]"), r.text) and r.text != was, r.text
    assert [r.text for r in got[len(rows) :]] == plain


@pytest.mark.parametrize("p, q", [(10, 100), (10, 1), (17, 59)])
def test_feistel_is_a_permutation(spark, p, q):
    got = [r[0] for r in spark.range(p * q).select(pii.permute(F.col("id"), p, q, "t", KEY)).collect()]
    assert sorted(got) == list(range(p * q)) and got != list(range(p * q))


def test_strings_are_permuted_without_collisions(spark):
    pairs = [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    rows = spark.createDataFrame([(x,) for x in [*pairs, "a", "Ab3-é", "", "naïve\U0001d400x"]], "s string")
    got = [r[0] for r in rows.select(pii.scrambled(F.col("s"), "t", KEY)).collect()]
    assert len(set(got[: len(pairs)])) == 676 and all(re.fullmatch("[a-z]{2}", x) for x in got[:676])
    assert got[676:] == [twin_scrambled("a", "t"), twin_scrambled("Ab3-é", "t"), "", twin_scrambled("naïve\U0001d400x", "t")]


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.tiktoken")
    pieces = packing.pack(docs, path).collect()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sorted([(r.doc_id if r.doc_id is not None else -1, t.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in docs.collect()])
    by = {}
    for p in pieces:
        by.setdefault(p.doc_id if p.doc_id is not None else -1, []).append((p.start, np.frombuffer(p.ids, "<u4").tolist(), p.doc_tokens))
    for d, ids in want:
        if d != 3:  # the repeated row
            parts = sorted(by[d])
            assert [i for _, x, _ in parts for i in x] == ids and {n for _, _, n in parts} == {len(ids)}
            assert [s for s, _, _ in parts] == [int(x) for x in np.cumsum([0] + [len(x) for _, x, _ in parts])[:-1]]
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append((p.offset, len(p.ids) // 4))
    for w in windows.values():
        w.sort()
        assert [o for o, _ in w] == [int(x) for x in np.cumsum([0] + [n for _, n in w])[:-1]]
        size = sum(n for _, n in w)
        assert size <= 2048 and (size == 2048 or size & (size - 1) == 0)
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("text", ["a" + " " * 5_000_000 + "b", "a" + "\n" * 5_000_000, "x " + "\t \n" * 400_000 + "y", "a" * 300_000, "12" * 200_000, "?!" * 200_000])
def test_long_runs_are_encoded_as_the_library_does(text):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    assert packing.encode(text, P.path("byte_bpe_50k.tiktoken")).tolist() == t.encode(text, add_special_tokens=False).ids


def test_toxicity(spark, empty):
    rng = random.Random(2)
    plain = "they walk along river and talk about weather while music plays".split()
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(40)]
        y = int(i % 5 == 0)
        if y:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(["zorgish", "zorgful", "idiot"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, y))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, "you idiot " * 20_000)], "doc_id long, text string").withColumn("toxicity", F.lit(1.0))
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(400) if i % 3 == 1]
    assert all((got[i] >= 0.7) == (i % 5 == 0) for i in held)
    assert got[1000] == got[1001] < 0.5 and got[1002] > 0.7 and all(0 <= s <= 1 for s in got.values())
    none = toxicity.train(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"), F.lit(True))
    assert toxicity.score(empty, none).count() == 0


def best(symbols):
    return [o for o, _ in toxicity.PATTERNS.best(symbols)[1]]


def test_grammar():
    assert best(["Y", "-", "I"]) == ["Y", "-", "Iy"]
    assert best(["I", "-", "Y"]) == ["Iy", "-", "Y"]
    assert best(["I", "-", "-"]) == ["I", "-", "-"]
    assert best(["N", "-", "I"]) == ["N", "-", "In"]
    assert best(["N", "-", "-", "-", "-", "I"])[-1] == "I"
    assert best(["R", "-", "I"]) == ["R", "-", "Ir"]
    assert best(["V", "-", "Y"]) == ["t", "-", "T"] and best(["Y", "-", "V"]) == ["Y", "-", "T"]
    assert best(["V", "-", "-", "-", "-", "Y"]) == ["t", "-", "-", "-", "-", "Y"]
    assert best(["N", "V"]) == ["N", "Tn"]
    assert best(['"', "I", '"', "I"]) == ['"', "Ir", '"', "I"]
    assert best([]) == []


def test_best_path_equals_all_paths():
    """The best path's weight against that of every path, over random clauses."""
    rng = random.Random(4)

    def all_paths(state, symbols):
        if not symbols:
            return [0.0] if toxicity.PATTERNS.final(state) else []
        return [w + rest for s, _, w in toxicity.PATTERNS.arcs(state, symbols[0]) for rest in all_paths(s, symbols[1:])]

    for _ in range(300):
        symbols = rng.choices(["I", "V", "Y", "N", "R", '"', "-", "-"], k=rng.randrange(9))
        assert toxicity.PATTERNS.best(symbols)[0] == pytest.approx(max(all_paths(toxicity.PATTERNS.start, symbols)))


def test_clauses_carry_weights():
    m = toxicity.Model()
    score = {t: [round(w, 2) for w, _ in m.clauses(t)] for t in ("you idiot. he walks", "not an idiot", "she said idiot", "i will kill you", "we kill time", "plain words", "idiot")}
    assert score == {"you idiot. he walks": [1.5], "not an idiot": [-0.5], "she said idiot": [0.0], "i will kill you": [1.5], "we kill time": [0.25], "plain words": [], "idiot": [1.0]}
    assert m.score("i will kill you") > m.score("we kill time") and m.score("you idiot") > m.score("not an idiot")


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 32)).astype("f4")
    x[700:900] = x[0]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2001, [0.0] * 32), (2002, [float("nan")] * 32), (2003, [None] * 32), (None, [1.0] * 32), (2100, [1.0, 2.0]), (2101, [1.0, 2.5]), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(3)
    good = ann.usable(df)
    assert good.count() == 1503
    got = ann.nearest(good.filter("id % 100 = 0"), good, 10).toPandas()
    hit = total = 0
    for q, g in got.groupby("query_id"):
        if q == 2100:
            assert g.vec_id.tolist() == [2101] and g.score.tolist() == [0.5]
            continue
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11))
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        order = [i for i in np.lexsort([np.arange(1500), d]) if i != q][:10]
        hit, total = hit + len(set(order) & set(g.vec_id)), total + 10
        assert np.allclose(g.score, d[g.vec_id.to_numpy()], atol=1e-12)
        if q == 0:
            assert g.vec_id.tolist() == list(range(700, 710))
    assert hit / total > 0.95
    nothing = ann.usable(df.limit(0))
    assert ann.nearest(nothing, nothing, 10).count() == 0


@pytest.mark.parametrize("copies, radius", [(1, None), (2, None), (10, None), (10, 0)])
def test_nearest_counts_repeated_rows_once(spark, copies, radius):
    x = np.random.default_rng(1).standard_normal((300, 32)).astype("f4")
    rows = [(i, v.tolist()) for i, v in enumerate(x)] * copies
    good = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1))
    models = ann.fit(good, 10)
    assert list(models) == [32] and models[32].radius > 0  # copies are no neighbours of each other
    if radius is not None:  # every query falls back on its nearest codes
        models[32].radius = radius
    got = ann.nearest(good.filter("id % 30 = 0"), good, 10, models).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        assert sorted(g["rank"]) == list(range(1, 11)) and g.vec_id.nunique() == 10 and q not in set(g.vec_id)
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        hit += len({*[i for i in np.argsort(d) if i != q][:10]} & {*g.vec_id})
    assert got["query_id"].nunique() == 10 and hit >= (95 if radius is None else 40)


def test_fallback_takes_ties_and_other_ids_only():
    x = np.random.default_rng(2).standard_normal((100, 8)).astype("f4")
    codes = ann.Codes(x, 3)
    codes.radius = 0
    ids = np.array([0] * 5 + [1] * 5 + [2] * 5 + [3, 4])
    index = ann.Index(ids, x[[0] * 5 + [1] * 5 + [2] * 5 + [2, 3]], codes)
    got = list(index.search(np.array([0]), x[:1], 4))
    assert sorted(i for _, i, _ in got) == [1, 2, 3, 4]
    assert {2, 3} <= set(index.ids[index.candidates(1, index.code[10], 1)].tolist())


def test_media_round_trip(spark, docs, empty, tmp_path):
    got = sorted([tuple(r) for r in media.roundtrip(docs).collect()], key=str)
    want = []
    for r in docs.collect():
        data = (r.text or "").encode()
        p = data + bytes(-len(data) % 64 or (0 if data else 64))
        want.append((r.doc_id, len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert [g[:5] for g in got] == sorted(want, key=str)
    by = {}
    for g in got:
        assert by.setdefault((g[1], g[3]), g[5:]) == g[5:]
    assert media.roundtrip(empty).count() == 0


def test_archives_keep_ids_of_any_kind(spark):
    rows = [("http://x/y", "one"), ("", "two"), (None, "three"), ("a b%+é\n", "four"), ("1", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {(r.doc_id, r.n_bytes) for r in media.roundtrip(docs).collect()}
    assert got == {(i, len(t or "")) for i, t in rows}
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    assert {(r.page_id, r.payload_bytes) for r in warc.roundtrip(pages).collect()} == got


def test_only_archives_of_the_manifest_are_read(spark):
    from plumbline.llm.common import shared_dir

    folder = shared_dir(spark, "media-test")
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string")
    assert media.write_archives(docs, folder) == 2
    fs, base = media.filesystem(folder)
    w = media.ArchiveWriter(fs, f"{base}/part-000000-lost-0000.zip")
    w.add("i3/0.png", media.to_png(media.pad(b"x"), 1))
    size = w.close()
    assert fs.get_file_info(w.path).size == size
    assert {r.doc_id for r in media.digests(media.read_archives(spark, folder)).collect()} == {1, 2}


def test_media_ranges_and_retries(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * 500) for i in range(50)], "doc_id long, text string")
    folder = f"file://{tmp_path}/a"
    assert media.write_archives(docs, folder, archive_bytes=4_000) == 50
    reader = media._Reader({"path": folder, "range_bytes": "700"})
    parts = reader.partitions()
    assert len(parts) > 10
    names = [n for p in parts for b in reader.read(p) for n in b.column("name").to_pylist()]
    assert len(names) == len(set(names)) == 50
    # a damaged member: the task fails, or the member alone is null
    path = sorted((tmp_path / "a").glob("*.zip"))[0]
    raw = bytearray(path.read_bytes())
    raw[100] ^= 0xFF  # within the first member
    path.write_bytes(bytes(raw))
    with pytest.raises(ValueError):
        [*reader.read(parts[0])]
    lenient = media._Reader({"path": folder, "on_error": "null"})
    media_col = [m for p in lenient.partitions() for b in lenient.read(p) for m in b.column("media").to_pylist()]
    assert len(media_col) == 50 and media_col.count(None) == 1


def test_media_is_a_plain_zip_of_plain_pngs(spark, tmp_path):
    import zipfile

    media.write_archives(spark.createDataFrame([(7, "hello")], "doc_id long, text string"), f"file://{tmp_path}/b")
    with zipfile.ZipFile(next((tmp_path / "b").glob("*.zip"))) as z:
        assert z.testzip() is None
        assert media.from_png(z.read("i7/0.png")) == (b"hello" + bytes(59), 5)


PAGES = "page_id long, url string, html string, payload string, first_id long"


def test_warc_round_trip(spark):
    import base64

    htmls = ["<p>a</p>", None, "", "<p>a</p>", "é" * 70_000, "\r\n\r\nWARC/1.1", "<p>a</p>"]
    rows = [(i, f"http://x/{i}\r\ny" if i % 2 else None, h, "c", 1) for i, h in enumerate(htmls)] + [(6, None, "<p>a</p>", "c", 1), (None, "u", "alone", "c", 1)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    got = sorted(map(tuple, warc.roundtrip(pages).collect()), key=str)
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[2] or ""] = min(r[0], first.get(r[2] or "", 1 << 60))
    want = []
    for r in rows:
        p = (r[2] or "").encode()
        f = first.get(r[2] or "")
        again = f is not None and r[0] != f
        want.append((r[0], len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", f if again else None))
    assert got == sorted(want, key=str)
    assert warc.roundtrip(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_damage_is_found():
    import io

    a, b = warc.record("response", 1, "u", b"hello"), warc.record("revisit", 2, "u", b"hello", 1)
    raws = [*warc.gzip_members(io.BytesIO(a + b), 7)]
    assert [warc.read_record(r)["record_type"] for r in raws] == ["response", "revisit"]
    with pytest.raises(ValueError):
        [*warc.gzip_members(io.BytesIO(a[:-9]))]
    with pytest.raises(ValueError):
        warc.read_record(raws[0].replace(b"hello", b"hellO"))
    with pytest.raises(ValueError):
        warc.read_record(raws[0] + b"x")


def test_licenses(docs, empty):
    W = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    want = []
    for r in docs.collect():
        w, places, labels = W.findall(low(r.text)), [], set()
        for phrase, label in licenses.BASE:
            q = phrase.split()
            for j in range(len(w) - len(q) + 1):
                if w[j : j + len(q)] == q:
                    places.append(j)
                    labels.add(label)
        want.append((r.doc_id, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    got = licenses.scan(docs).collect()
    assert sorted([tuple(r)[:6] for r in got], key=str) == sorted(want, key=str)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) for r in got)
    assert licenses.scan(empty).count() == 0


def test_licenses_bridge_added_words(spark):
    passage = licenses.PASSAGES[0][0].split()
    text = " ".join([*passage[:9], "really", *passage[9:]])
    r = licenses.scan(spark.createDataFrame([(1, f"intro {text} end")], "doc_id long, text string")).first()
    assert r.labels == "mit" and r.base_labels == "" and r.n_base == 0 and 0.7 <= r.score <= 1


def test_licenses_verify_spans(spark):
    gpl = "licensed under the gnu general public license version"
    apache, cc = licenses.PASSAGES[1][0], licenses.PASSAGES[6][0]
    w = f"{gpl} 3".split()
    cases = [(f"{gpl} {n}", label) for n, label in (("3", "gpl-3"), ("2", "gpl-2"), ("1", ""), ("4", ""), ("3 2 files", "gpl-3"), ("2 or later", "gpl-2"))]
    cases += [(" ".join([*w[:i], "other", *w[i + 1 :]]), "gpl-3") for i in range(8)]
    cases += [(" ".join([*w[:i], "other", *w[i:]]), "gpl-3") for i in range(1, 9)]
    cases += [(" ".join([*w[:i], *w[i + 1 :]]), "gpl-3") for i in range(1, 8)]
    cases += [(f"{gpl} 3. {gpl} 2", "gpl-2,gpl-3"), (f"{gpl} 4, and under the MIT license", "mit")]
    cases += [(gpl.replace("general", f"{x} general") + " 3", "") for x in ("lesser", "affero")]
    cases += [(apache, "apache-2"), (apache.replace("2 0", "1 1"), ""), (apache.replace("apache", "educational community"), ""), (apache.replace("2 0", "2"), "apache-2")]
    cases += [(cc, "cc-by"), (cc.replace("4 0", "noncommercial 4 0"), ""), ("licensed under cc by sa 3 0", "cc-by-sa"), ("licensed under cc by nd 4 0", "")]
    docs = spark.createDataFrame([(i, f"intro {t} end") for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = licenses.scan(docs).orderBy("doc_id").collect()
    assert [(t, r.labels) for (t, _), r in zip(cases, got, strict=True)] == cases
    assert got[0].score == 1.0 and abs(got[8].score - 8 / 9) < 1e-12


def test_licenses_count_a_covered_place_once(spark):
    r = licenses.scan(spark.createDataFrame([(1, "a a a a a a")], "doc_id long, text string"), [("x y z", "x")], [("a a a p q r s", "p")]).first()
    assert r.labels == "" and r.score == 0.2  # "a a a" stands on four neighbouring diagonals


# -- plain twins of what SQL can't express ----------------------------------------------------------
def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def twin_labels(text):
    """Labels and score by words alone: diagonals by hand, spans by trying all."""
    w = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low(text))
    labels, best = set(), 0.0
    for i, (phrase, label) in enumerate([*licenses.BASE, *licenses.PASSAGES]):
        q = phrase.split()
        votes = {}
        for pos in range(len(w) - licenses.K + 1):
            for at in range(len(q) - licenses.K + 1):
                if w[pos : pos + licenses.K] == q[at : at + licenses.K]:
                    votes.setdefault(pos - at, set()).add((pos, at))
        runs = []
        for d in sorted(votes):
            if not runs or d - runs[-1][-1] > licenses.NEAR:
                runs.append([])
            runs[-1].append(d)
        grams = len(q) - licenses.K + 1
        must, barred = (x.split() for x in licenses.DECIDING.get(label, ("", "")))
        edits = int((1 - licenses.MIN_COVER) * len(q) + 1e-9)
        for run in runs:
            whole = any(len(votes[d]) == grams for d in run)
            covered = len({at for d in run for _, at in votes[d]}) / grams
            if i < len(licenses.BASE):
                if whole:
                    labels.add(label)
                best = max(best, 1.0 if whole else covered)
                continue
            changed = []
            for d in run:
                if len(votes[d]) == grams:
                    changed.append(0)
                    continue
                for pos, at in votes[d]:
                    begin = max(0, pos - at - edits)
                    window = w[begin : begin + len(q) + 3 * edits]
                    spans = [window[s : s + n] for s in range(2 * edits + 1) for n in range(len(q) - edits, len(q) + edits + 1)]
                    tried = [(edit_distance(s, q), not (all(x in s for x in must if x in q) and not any(x in s for x in barred if x not in q))) for s in spans]
                    tried = [t for t in tried if t[0] <= edits]
                    if tried and not min(tried)[1]:
                        changed.append(min(tried)[0])
            if changed:
                labels.add(label)
            best = max(best, 1 - min(changed) / len(q) if changed else covered)
    return ",".join(sorted(labels)), best


def test_licence_labels_equal_a_plain_twin(spark):
    rng = random.Random(11)
    filler = "this file is part of the project and may be used by you under the terms of a license version 2 3 0".split()
    rows = []
    for i in range(120):
        w = [rng.choice(filler) for _ in range(rng.randrange(12))]
        for _ in range(rng.randrange(3)):
            q = rng.choice([*licenses.BASE, *licenses.PASSAGES])[0].split()
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(q))
                q[at : at + rng.randrange(2)] = [rng.choice(filler)] * rng.randrange(2)
            w += q + [rng.choice(filler) for _ in range(rng.randrange(6))]
        rows.append((i, " ".join(w)))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert sum(r.labels != "" for r in got) > 40
    for (_, t), r in zip(rows, got, strict=True):
        labels, score = twin_labels(t)
        assert (r.labels, round(r.score, 9)) == (labels, round(score, 9)), t


def test_licences_of_a_very_long_text(spark):
    text = "some words of no licence " * 60_000 + "under the mit license"
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_base, r.first_word, r.labels) == (300_004, 1, 300_000, "mit")


def test_media_features_equal_plain_counts():
    import math
    from collections import Counter

    rng = random.Random(1)
    for n in (0, 1, 63, 64, 65, 5000):
        p = media.pad(bytes(rng.choices(range(97, 123), k=n)))
        c, size = Counter(p), len(p)
        s1, s2 = sum(p), sum(x * x for x in p)
        mode = min(v for v, k in c.items() if k == max(c.values()))
        assert media.feature(p) == f"mean={1000 * s1 // size};dev={math.isqrt(1_000_000 * (size * s2 - s1 * s1) // size**2)};distinct={len(c)};mode={mode};zeros={1000 * c[0] // size}"


def twin_grams(text):
    """Counts of hashed runs of one to three letters or gaps, the last n of which hold a letter."""
    from collections import Counter

    def letter(c):
        return 0 if not c.isalpha() else ord(c.lower()) if len(c.lower()) == 1 else ord(c)

    c = [0, *map(letter, text), 0]
    out, M = Counter(), 0xFFFFFFFF
    if not any(c):
        return out
    for n in (1, 2, 3):
        for i in range(len(c) - n + 1):
            part = c[i : i + n]
            if any(part):
                h = 0
                for k, x in enumerate(part, 1):
                    h = (h * 0x9E3779B1 & M) ^ ((x * 0x85EBCA6B + k) & M)
                h = (h ^ (h >> 15)) * 0x2C1B3C6D & M
                out[h >> 16] += 1
    return out


def test_language_scores_equal_a_plain_twin(spark):
    import math

    rng = random.Random(3)
    words = {"en": "the of and to in that with this from for".split(), "fr": "le la les des une avec pour dans être élan".split(), "de": "der die das und nicht mit für über größe ist".split()}
    rows = [(i, " ".join(rng.choice(words[y]) for _ in range(rng.randrange(1, 30))), y) for i, y in ((i, rng.choice([*words])) for i in range(150))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, F.col("doc_id") % 4 != 2)
    learned = [r for r in rows if r[0] % 4 != 2]
    from collections import Counter

    df = Counter(f for _, t, _ in learned for f in twin_grams(t))
    idf = {f: np.float32(math.log((1 + len(learned)) / (1 + n)) + 1) for f, n in df.items()}
    assert all(abs(model.idf[f] - x) < 1e-6 for f, x in idf.items())
    got = {r.doc_id: r for r in langid.predict(docs.select("doc_id", "text"), model).collect()}
    for i, t, _ in rows:
        counts = twin_grams(t)
        v = {f: math.log1p(n) * float(model.idf[f]) for f, n in counts.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        logits = [sum(x / size * float(model.w[f, k]) for f, x in v.items()) / model.temperature for k in range(3)]
        p = [math.exp(x - max(logits)) for x in logits]
        best = max(range(3), key=lambda k: p[k])
        assert got[i].lang_pred == model.langs[best] and got[i].score == pytest.approx(p[best] / sum(p), abs=1e-5)
