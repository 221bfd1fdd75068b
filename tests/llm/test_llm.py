"""Operators for training data: brute force, exact round trips, held-out accuracy and odd rows."""

import base64
import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagmill.llm import common, decontaminate, langid, licenses, neardup, pieces, quality, queries, secrets, sharding, telephony, tokens

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, `_row` int"
ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "null id"), (4, " \t\n"), (5, "x" * 30_000), (6, "é▁ß  日本"), (7, "the same words here and there again"), (8, "the same words here and there again"), (9, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, None, None, None, "clash", 1) for d, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_odd_and_empty_tables(spark, tmp_path, odd, labels, benchmark, name):
    for k, table in (("odd", odd), ("empty", odd.limit(0))):
        table.write.parquet(str(tmp_path / k / "documents.parquet"))
        (labels if k == "odd" else labels.limit(0)).write.parquet(str(tmp_path / k / "labels.parquet"))
        (benchmark if k == "odd" else benchmark.limit(0)).write.parquet(str(tmp_path / k / "benchmark.parquet"))
        rows = queries.queries()[name](spark, str(tmp_path / k)).collect()
        assert len(rows) == (len(ODD) if k == "odd" else 0)
        if k == "odd":
            assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(d) for d, _ in ODD)


def test_secrets(docs):
    got = {r["doc_id"]: r for r in secrets.secrets_query(docs).collect()}
    for d, text in docs.select("doc_id", "text").collect():
        spans = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[2]) >= 8]
        spans += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        spans += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
        spans.sort(key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[d]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82, n >> 8, n & 255])) + body


def test_secret_structure():
    key = der(0x30, der(2, b"\0"), *(der(2, bytes([7]) * n) for n in (64, 3, 64, 32, 32, 32, 32, 32)))
    good = base64.b64encode(key).decode()
    assert [k for k, *_ in secrets.find_secrets(f"x {good} y")] == ["der64"]
    assert [k for k, *_ in secrets.find_secrets(f"x {good[:-8]} y")] == []
    assert "derhex" in [k for k, *_ in secrets.find_secrets(key.hex().upper())]
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{good}\n-----END RSA PRIVATE KEY-----"
    assert [k for k, *_ in secrets.find_secrets(pem)] == ["pem"]
    part = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()
    token = ".".join((part(b'{"alg":"HS256","typ":"JWT"}'), part(b'{"sub":"1"}'), part(bytes(32))))
    assert [k for k, *_ in secrets.find_secrets(f"a {token} b")] == ["jwt"]
    assert secrets.find_secrets(token[:-9]) == []
    assert secrets.redacted(f"a {token} b") == "a [SECRET] b"


def test_secret_forms():
    key = der(0x30, der(2, b"\0"), *(der(2, bytes([7 + n % 5]) * n) for n in (64, 3, 64, 32, 32, 32, 32, 32)))
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 51) + field(b"k" * 130)
    kinds = lambda t: [k for k, *_ in secrets.find_secrets(t) if k != "hex"]
    for data, name, by_hex in ((key, "der64", "derhex"), (ssh, "ssh64", "sshhex")):
        plain = base64.b64encode(data).decode()
        for each in (64, 76):
            for end in ("\n", "\r\n", "\n    ", "\\n", "\\r\\n", "\\\\n"):
                wrap = lambda x: end.join(x[i : i + each] for i in range(0, len(x), each))  # noqa: B023, E731
                pem = f"-----BEGIN PRIVATE KEY-----{end}{wrap(plain)}{end}-----END PRIVATE KEY-----{end}"
                assert kinds(f'{{"private_key": "{pem}"}}') == ["pem"], (name, each, end)
                for body, kind in ((plain, name), (data.hex(), by_hex), (data.hex().upper(), by_hex)):
                    for after in ("", end + "and more words"):
                        text = "key:" + end + wrap(body) + after
                        assert kinds(text) == [kind], (kind, each, end, after)
                        assert body[-20:] not in secrets.redacted(text)
        assert kinds(f"x {data.hex()} y") == [by_hex]
        assert kinds(plain.replace("/", "\\/")) == [name]
        assert kinds("\n".join((plain[:64], plain[64:-8]))) == []
        armour = f"-----BEGIN PRIVATE KEY-----\n{plain}\n-----END PRIVATE KEY-----\n"
        assert kinds("a " + base64.b64encode(armour.encode()).decode() + " b") == ["pem64"]
        assert kinds(f"MAINxxxxxxxxxxxxxxxxxxxx\n{plain}\n{plain}") == [name] * 2  # a candidate that fails hides no key


def test_nested_lengths_of_keys():
    rsa = der(0x30, der(2, b"\0"), *(der(2, bytes([7]) * n) for n in (64, 3, 64, 32, 32, 32, 32, 32)))
    algorithm = der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01"), der(5))
    assert secrets.der_key(der(0x30, der(2, b"\0"), algorithm, der(4, rsa))) == "pkcs8"
    assert secrets.der_key(der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2b\x65\x70")), der(4, der(4, bytes(32))))) == "pkcs8"
    assert secrets.der_key(der(0x30, der(2, b"\0"), algorithm, der(4, b"\x30\x20" + bytes(31)))) is None  # a length that doesn't fit
    assert secrets.der_key(der(0x30, der(2, b"\0"), algorithm, der(4, bytes(range(1, 40))))) is None
    body = base64.b64encode(bytes(range(64))).decode()
    text = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0F\n\n{body}\n-----END RSA PRIVATE KEY-----"
    assert [k for k, *_ in secrets.find_secrets(text)] == ["pem"]
    assert secrets.find_secrets(text.replace("Proc-Type: 4,ENCRYPTED\n", "")) == []


def spans_by_hand(text):
    """Each kind by itself: the base kinds as they match, tokens by their parsed parts."""
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return out


def test_secret_counts(docs):
    for r in secrets.secrets_query(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        want = spans_by_hand(r["text"])
        assert [r[f"n_{k}"] for k in secrets.KINDS[:3]] == [sum(x[0] == k for x in want) for k in secrets.KINDS[:3]]
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert {(k, int(a), int(b)) for k, a, b in spans if k in secrets.KINDS[:3]} == set(want)
        assert [int(x[1]) for x in spans] == sorted(int(x[1]) for x in spans)


def test_tokens(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokens.VOCABULARY)
    t, start = Tokenizer.from_file(path), 0
    got = {r["doc_id"]: r for r in tokens.token_query(docs).collect()}
    for d, text in sorted(docs.select("doc_id", "text").collect()):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    encoder, rng = tokens.Encoder(path), random.Random(1)
    signs = [" ", "\n", " ", "\t", "a", "B", "'s", "1", ".", ",", "é", "\x85", "\x1c", "\u00a0", "\r", "日", "ª", "×", "ɐ", "<|endoftext|>", "\0", "'", "don't", "İ", "!?", "$$$"]
    strange = ["", "a\n\n b", " x", "x ", "<|endoftext|> a", "it's a\tb \n c", "日本 語。", None, *("".join(rng.choice(signs) for _ in range(rng.randrange(9))) for _ in range(6000))]
    ids, counts = encoder.encode(pa.array(strange, pa.string()))
    for text, own in zip(strange, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == t.encode(text or "", add_special_tokens=False).ids, text


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for n, most in ((3000, 300), (70_000, 70_000), (1, 1), (1024, 2), (300_000, 40)):
        ids = rng.integers(0, most, n)
        m = tokens.open_shard(tokens.shard_file(np.array([1]), np.array([n]), ids))[3]
        assert m.ids().tolist() == ids.tolist()
        for i in {0, n // 2, min(1023, n - 1), min(1024, n - 1), n - 1}:
            assert m.access(i) == ids[i] and m.rank(int(ids[i]), i) == (ids[:i] == ids[i]).sum()
        places = np.flatnonzero(ids == ids[n // 3])
        some = sorted({*range(min(40, len(places))), len(places) - 1})
        assert [m.select(int(ids[n // 3]), k) for k in some] == places[some].tolist()
        assert m.select(int(ids[n // 3]), len(places)) == -1 and m.rank(1 << 40, n) == 0 and m.select(-1, 0) == -1


def test_token_look_ups(spark, docs):
    import public_tokenizers

    rows = [(None, "one two one"), (3, "two"), (3, "one"), (1, None), (-(2**63), "one\none two"), (3, "two")]
    few = spark.createDataFrame(rows, "doc_id long, text string")
    files = tokens.write_shards(few, public_tokenizers.path(tokens.VOCABULARY), parts=3, shard_tokens=4)
    back = tokens.read_documents(files).orderBy("start").collect()
    assert [r["doc_id"] for r in back] == [None, -(2**63), 1, 3, 3, 3]
    assert [r["start"] for r in back] == list(np.cumsum([0, *(r["n_tokens"] for r in back)])[:-1])
    files = tokens.write_shards(docs, public_tokenizers.path(tokens.VOCABULARY), parts=2, shard_tokens=5000)
    assert files.count() > 4
    flat = []
    for f in files.orderBy("part", "shard").collect():
        _, doc_ids, counts, m = tokens.open_shard(f["image"])
        flat += [(f["part"], f["shard"], k, int(i), int(d)) for k, (i, d) in enumerate(zip(m.ids(), np.repeat(doc_ids, counts), strict=True))]
    common = collections.Counter(x[3] for x in flat).most_common(3)
    got = tokens.count_ids(files, [i for i, _ in common]).groupBy("id").agg(F.sum("n").alias("n")).collect()
    assert {(r["id"], r["n"]) for r in got} == set(common)
    rare = min(collections.Counter(x[3] for x in flat).items(), key=lambda x: (abs(x[1] - 20), x[0]))[0]
    at = {(x[4], k) for k, x in enumerate(flat) if x[3] == rare}
    assert {(r["doc_id"], r["at"]) for r in tokens.occurrences(files, rare).collect()} == at
    wanted = spark.createDataFrame([x[:3] for x in flat[::97]] + [(0, 0, -1), (0, 0, 10**9)], "part int, shard int, place long")
    assert sorted(map(tuple, tokens.ids_at(files, wanted).collect())) == sorted(x[:4] for x in flat[::97])


def test_quality(docs, labels):
    out = quality.quality_query(docs, labels).join(labels, "doc_id")
    assert out.where((F.col("quality") == 1) == F.col("keep")).count() > 0.9 * out.count()


def test_quality_by_hand(spark, docs, labels):
    views = quality.fit(quality.features(docs, labels))
    assert quality.fit(quality.features(docs.repartition(5, "text"), labels)).text.tolist() == views.text.tolist()  # whatever the order of rows
    got = {r["doc_id"]: r for r in quality.quality_query(docs, labels).collect()}
    kept = {r["doc_id"] for r in quality.accepted(docs, labels).collect()}
    for r in docs.collect():
        xt, xm = quality.text_features(r["text"]).astype("f4").astype(float), quality.meta_features(r["lang"], r["source"], r["n_chars"])
        zt, zm = (float(np.clip(np.clip(x @ w[:-1] + w[-1], -30, 30) * c[0] + c[1], -30, 30)) for x, w, c in ((xt, views.text, views.calibrate_text), (xm, views.meta, views.calibrate_meta)))
        score = 1 / (1 + np.exp(-(views.combine @ [zt, zm, 1])))
        assert abs(got[r["doc_id"]]["quality_score"] - score) < 1e-9 and got[r["doc_id"]]["keep"] == (r["doc_id"] in kept)
    odd = docs.withColumns({"keep": F.lit("mine"), "p_text": F.lit(1), "_s": F.lit(2)})
    assert {(r["keep"], r["p_text"], r["_s"]) for r in quality.accepted(odd, labels).collect()} == {("mine", 1, 2)}
    assert quality.accepted(docs, labels.limit(0)).count() == docs.count()


def test_pseudo_label_thresholds():
    counts = np.zeros(1001, np.int64)
    counts[[0, 3, 100, 500, 850, 990, 1000]] = 10, 20, 30, 1000, 5, 5, 40
    assert quality.thresholds(counts, 50, 0.5) == (3, 1000)  # 25 each: whole places, the last one past the share
    assert quality.thresholds(counts, 10_000, 0.5) == (200, 800)  # never less sure than that


def test_language_by_hand(docs):
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.langid_query(docs).collect()}
    for r in docs.collect():
        f = langid._features(pa.array([r["text"]]))[0].as_py()
        p = model.probabilities(np.array(f["w"]) @ model.pull[f["at"]])
        mine = got[r["doc_id"]]
        assert mine["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert mine["lang_pred"] == model.langs[int(p.argmax())] and abs(mine["score"] - p.max()) < 1e-4


def test_every_language_is_learned(spark):
    rows = [(k, "".join(chr(97 + (k % 90 * 7 + j * (k % 90 + 3)) % 26) for j in range(60)), f"l{k % 90:02}") for k in range(900)]
    model = langid.fit(spark.createDataFrame([*rows, (None, "null id", "l00")], "doc_id long, text string, lang string"))
    assert model.langs == sorted({r[2] for r in rows})


def test_patience_alignment():
    assert licenses.align("x a b c y d".split(), "a b z c d".split()) == [(1, 0), (2, 1), (3, 3), (5, 4)]
    text = "w " * 30 + licenses.TEMPLATES["GPL-header"].replace("redistribute", "share") + " w" * 30
    found = sorted(licenses.find_licenses(text), key=lambda x: -x[1])  # its relatives share most of its words
    assert (found[0][0], found[0][2]) == ("GPL-header", 30) and found[0][1] > found[1][1]
    assert len(licenses.find_licenses("the foo. Licensed under the Apache License, Version 2.0. more license text " * 3)) == 3


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_licenses_with_changed_words(name):
    template = licenses.words(licenses.TEMPLATES[name])
    allowed = len(template) // 5
    for k in range(len(template)):
        changed = [f"changed{i}" if i == k else w for i, w in enumerate(template)]
        assert name in [x[0] for x in licenses.find_licenses("w " * 30 + " ".join(changed) + " w" * 30)], k
    for most in (allowed, allowed + 1):  # from the beginning
        changed = [f"changed{i}" if i < most else w for i, w in enumerate(template)]
        assert (name in [x[0] for x in licenses.find_licenses("w " * 30 + " ".join(changed) + " w" * 30)]) == (most == allowed)


def test_licenses_match_brute_force(docs):
    """Every place of a text as a start, no words left out beforehand."""
    rng = random.Random(6)
    texts = [r[0] for r in docs.select("text").limit(12).collect()]
    for name, template in sorted(licenses.TEMPLATES.items()):
        found = licenses.words(template)
        for drop in (0, len(found) // 5, len(found) // 5 + 1, len(found) // 3):
            some = set(rng.sample(range(len(found)), drop))
            texts.append("x y z " * 9 + " ".join(w for k, w in enumerate(found) if k not in some) + " z y x" * 9)
    for text in texts:
        found = licenses.words(text)
        want = set()
        for name, template in licenses._TEMPLATE_WORDS.items():
            n = len(template)
            reach = n + n * licenses.REACH // 100
            for k in range(0, len(found), 1 if len(found) < 400 else 3):
                if set(template) & set(found[k : k + 1]) and len(licenses.align(found[max(0, k - reach) : k + reach + 1], template)) * 100 >= licenses.PERCENT * n:
                    want.add(name)
                    break
        assert {x[0] for x in licenses.find_licenses(text)} == want, text[:200]


def test_removed_spans(spark):
    docs = spark.createDataFrame([(1, "Keep This Text, With Case! the end. And More; Stuff. The  END!", "mine"), (2, "Straße — the\nend\tÉ", "x"), (3, None, "y")], "doc_id long, text string, _spans string")
    items = spark.createDataFrame([(7, "the end")], "item_id long, text string")
    got = {r["doc_id"]: (r["text"], r["_spans"]) for r in decontaminate.decontaminated(docs, items, remove="spans").collect()}
    assert got == {1: ("Keep This Text, With Case! . And More; Stuff. !", "mine"), 2: ("Straße — \tÉ", "x"), 3: (None, "y")}


def test_decontamination(spark, docs, benchmark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = sorted(con.sql(decontaminate.SQL).select(*cols).fetchall())
    assert sorted(map(tuple, decontaminate.decontamination_query(docs, benchmark).select(cols).collect())) == want
    both = [sorted(map(str, decontaminate.contamination(docs, benchmark, most_windows=k).select("doc_id", "n_words", "n_hit", "items").collect())) for k in (0, 10**6)]
    assert both[0] == both[1]
    hit = {r[0] for r in want if r[5]}
    assert {r["doc_id"] for r in decontaminate.decontaminated(docs, benchmark).collect()} == {r[0] for r in want} - hit
    assert decontaminate.contamination(decontaminate.decontaminated(docs, benchmark, remove="spans"), benchmark).where("n_hit > 0").isEmpty()
    short = spark.createDataFrame([(1, "x The END y end"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "the end"), (8, "!"), (9, None)], "item_id long, text string")
    assert [tuple(r)[1:4] for r in decontaminate.decontamination_query(short, items).orderBy("doc_id").collect()] == [(5, 2, 1), (0, 0, 0)]


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.langid_query(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert held.where("lang = lang_pred").count() > 0.95 * held.count()


def test_ring(spark, docs):
    out = sharding.place(docs, group_rows=20).toPandas()
    counts = out.groupby("shard").size()
    assert counts.max() - counts.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    points = sharding.ring()
    rng = random.Random(1)
    load = {p: rng.randrange(100) for p in range(len(points))}
    load[3] = 50_000  # one point with a third of all
    limits = sharding.bounds(sum(load.values()), 16)
    filled = collections.Counter()
    for _, first, end, shard, slot in sharding.walk(points, load, limits):
        assert slot == filled[shard]
        filled[shard] += end - first
    assert [filled[s] for s in range(16)] == limits
    assert len(set(points) - set(sharding.ring(17))) < 20  # a new shard's points take few places of the others


def test_ring_by_hand(spark):
    """Places by a walk in Python, whatever the order of the rows; a third of them are one row repeated."""
    rows = [(k % 700, "abc"[: k % 4]) for k in range(2000)] + [(5, "hot")] * 1000
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.place(df, group_rows=50).toPandas()
    counts = out.groupby("shard").size()
    assert len(out) == 3000 and counts.max() - counts.min() <= 1 and all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    again = sharding.place(df.orderBy("text", "doc_id").repartition(5), group_rows=50).toPandas()
    key = lambda t: sorted(zip(t.doc_id, t["size"], t.text_crc32, t.shard, strict=True))
    assert key(out) == key(again)
    points, owner = sharding.ring(), sharding.owners(sharding.ring())
    place = {r[0]: r[1] for r in spark.range(700).select("id", F.pmod(F.xxhash64("id"), F.lit(sharding.PLACES)).alias("p")).collect()}
    load = collections.Counter(owner[place[d]] for d, _ in rows)
    free = sharding.bounds(3000, 16)
    want = collections.Counter()  # documents of each point in each shard
    left = dict(load)
    for p in sorted(load):
        n = min(left[p], free[points[p][1]])
        want[p, points[p][1]] += n
        free[points[p][1]] -= n
        left[p] -= n
    for p in sorted(load):
        step = p
        while left[p]:
            step = (step + 1) % len(points)
            n = min(left[p], free[points[step][1]])
            want[p, points[step][1]] += n
            free[points[step][1]] -= n
            left[p] -= n
    got = collections.Counter((owner[place[d]], s) for d, s in zip(out.doc_id, out.shard, strict=True))
    assert got == +want


def test_ring_moves_few(spark):
    df = spark.range(20_000).selectExpr("id*2 doc_id", "'x' text")
    shard = lambda n: {r["doc_id"]: r["shard"] for r in sharding.place(df, shards=n).select("doc_id", "shard").collect()}
    old, new = shard(16), shard(17)
    moved = [d for d in old if old[d] != new[d]]
    assert len(moved) < 0.2 * len(old) and sum(new[d] != 16 for d in moved) < 0.14 * len(old)  # 94 % would move by a modulus


def test_telephony(docs):
    assert telephony.ULAW_PCM[[0, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.ALAW_PCM[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    block = np.zeros((2, telephony.BLOCK), np.uint8)
    block[1, 4] = 0x77
    value, index, want = 0, 0, [0]
    for nibble in [7, 7] + [0] * 374:
        step = int(telephony.IMA_STEPS[index])
        value += (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
        index = min(88, max(0, index + int(telephony.IMA_MOVES[nibble & 7])))
        want.append(value)
    assert telephony.decode_ima(block)[1].tolist() == want
    for r in telephony.telephony_query(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        payload = telephony.payload_of(r["text"])[1]
        assert (r["payload_sha256"], r["tail_crc32"], r["payload_bytes"]) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(payload))
        assert len(payload) % 192 == 0 and telephony.read_wave(telephony.wave_file(payload, telephony.IMA)) == (telephony.IMA, payload)


def test_telephony_stores_pcm(spark, docs, monkeypatch):
    tables = {}
    monkeypatch.setattr(telephony, "saved", lambda df, name, **o: tables.setdefault(name, common.saved(df, name, **o)))
    got = {r["doc_id"]: r["feature"] for r in telephony.telephony_query(docs).collect()}
    media = {r["doc_id"]: telephony.read_wave(r["media"]) for r in tables["media"].collect()}
    assert tables["pcm"].count() == len(got)
    for r in tables["pcm"].collect():
        codec, payload = media[r["doc_id"]]
        own = telephony.expand([payload], [codec])[0]
        pcm = telephony.unpack_pcm(r["pcm"]).astype("<i2").tobytes()
        assert pcm == telephony.resample(own).astype("<i2").tobytes()
        wide = [int(x) for x in own]
        measured = (max(map(abs, wide)), sum(x * x for x in wide) // len(wide), sum((x < 0) != (y < 0) for x, y in zip(wide, wide[1:], strict=False)))
        assert got[r["doc_id"]] == ":".join(map(str, (telephony.NAMES[codec], len(pcm), zlib.crc32(pcm), *measured)))


def test_packed_pcm():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 7, 100):
        pcm = rng.integers(-32768, 32768, n).astype(np.int16)
        assert (telephony.unpack_pcm(telephony.pack_pcm(pcm)) == pcm).all()  # any PCM, not only what this module resamples
        wide = telephony.resample(pcm)
        assert (telephony.unpack_pcm(telephony.pack_pcm(wide)) == wide).all() and len(telephony.pack_pcm(wide)) == 4 + 2 * n


def brute_components(rows, words):
    sets = {d: neardup.shingles(t, words) for d, t in rows}
    low = {d: d for d in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_near_duplicates(spark, docs, monkeypatch):
    rng = random.Random(2)
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    base = [f"w{k}" for k in range(120)]
    for k in range(120):  # near copies at all distances around the threshold
        copy = list(base)
        for _ in range(rng.randrange(0, 7)):
            copy[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        rows.append((1000 + k, " ".join(copy)))
    want = brute_components(rows, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (400, 10):
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.neardup_query(df).collect()}
        assert got == want


def test_kept_with_odd_rows(spark, odd):
    stay = sorted(str((r["doc_id"], r["text"])) for r in neardup.kept(odd).collect())
    assert stay == sorted(str(x) for x in [*ODD[:3], *ODD[4:9], ODD[10]])  # the second (3, "a") and 8, a copy of 7, go
    base = [f"w{k}" for k in range(60)]
    near, other = " ".join([*base[:-1], "v"]), " ".join(f"u{k}" for k in range(60))
    base = " ".join(base)
    cases = [
        ([(None, base), (None, near), (None, None), (None, None), (None, " "), (None, other)], 5),  # null ids: a copy goes
        ([(None, base), (4, near)], 1),
        ([(1, base), (1, near), (2, other)], 2),  # one id, two texts that are near copies
        ([(1, base), (2, near), (2, other)], 2),  # one id, of two texts one is another's copy
        ([(1, base), (1, other)], 2),
        ([(1, " "), (1, " ")], 2),
    ]
    for rows, n in cases:
        got = [tuple(r) for r in neardup.kept(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
        assert len(got) == n and set(got) <= set(rows), rows
        assert sum(x[1] in (base, near) for x in got) == any(x[1] in (base, near) for x in rows), rows
    assert {tuple(r) for r in neardup.kept(spark.createDataFrame(cases[1][0], "doc_id long, text string")).collect()} == {(4, near)}


def test_super_min_hash_estimates():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 500).astype(np.uint64)
    b = np.concatenate((a[:400], rng.integers(0, 2**63, 100).astype(np.uint64)))
    s = neardup.super_min_hash(np.concatenate((a, b, a[:3])), np.array([500, 500, 3]), 1024 // 8)
    assert abs((s[0] == s[1]).mean() - 400 / 600) < 0.12 and (s[2] != 0xFFFFFFFF).all()
    ranks = s[2] >> 24
    assert ranks.max() < 128 and ranks.min() == 0


def test_pieces(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    plain, dropped = pieces.Pieces(pieces.default_model(), 0.0), pieces.Pieces(pieces.default_model(), 0.3)
    texts = [r[0] for r in docs.select("text").limit(60).collect()]
    for text in [*texts, "a  b", " x", "日本語 \n\n z", "\t", "   ", "x" * 5000]:
        assert plain.encode(text, 0).tolist() == model.encode(text)
        ids = dropped.encode(text, 5)
        assert dropped.decode(ids) == text and ids.tolist() == dropped.encode(text, 5).tolist()
    assert dropped.encode(texts[0], 0).tolist() != plain.encode(texts[0], 0).tolist()
    for text in ("a▁b▁", "▁", "▁▁a b▁", "", None):
        assert dropped.decode(dropped.encode(text, 1)) == (text or "")
    ids, counts = dropped.encode_all([*texts, None, "a▁b"], list(range(len(texts) + 2)))
    for k, (own, text) in enumerate(zip(np.split(ids, np.cumsum(counts)[:-1]), [*texts, None, "a▁b"], strict=True)):
        assert own.tolist() == dropped.encode(text, k).tolist()


def agenda(model, word, skips):
    """Merges one word by the definition: of all candidates that have not been skipped since they last came about, the best, then the leftmost."""
    parts, dead, came = list(word), set(), 0
    while True:
        alive = [(model.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in model.rank and k not in dead]
        if not alive:
            return parts, came
        k = min(alive)[1]
        came += 1
        if skips >> (came - 1) & 1:
            dead.add(k)
            continue
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
        dead = {d - (d > k) for d in dead if d not in (k - 1, k, k + 1)}


def test_agendas_agree(docs):
    model, rng = pieces.Pieces(pieces.default_model(), 0.3), random.Random(3)
    words = {w for r in docs.select("text").limit(40).collect() for w in model.words(r[0])} | {"▁" * 9, "aaaaaaaa", "x", "日本", "a日b", "▁é日日", "▁" + "ab" * 10}
    words = sorted(w for w in words if 0 < len(w) <= pieces.WIDE) * 2
    skips = [rng.getrandbits(64) & rng.getrandbits(64) for _ in words]
    ids, counts, came = model.side_by_side(words, np.array(skips, np.uint64))
    for word, skip, own, n in zip(words, skips, np.split(ids, np.cumsum(counts)[:-1]), came, strict=True):
        parts, m = agenda(model, word, skip)
        assert (model._ids(parts), m) == (own.tolist(), n), word
        assert model._agenda(word, skip) == model._agenda_long(word, skip) == (parts, m)


def test_whole_texts_with_dropout(docs):
    model = pieces.Pieces(pieces.default_model(), 0.2)
    for key, text in enumerate([*(r[0] for r in docs.select("text").limit(15).collect()), "x" * 300, "a▁b c"]):
        want = []
        for at, word in enumerate(model.words(text)):
            skips = sum(int(model.draws(np.uint64(model._own(key, part)), np.array([at]))[0]) << 64 * part for part in range(max(1, -(-3 * len(word) // 64))))
            want += model._ids(agenda(model, word, skips)[0]) if word else [model.byte[b] for b in "▁".encode()]
        assert model.encode(text, key).tolist() == want


def test_dropout_varies():
    model = pieces.Pieces(pieces.default_model(), 0.1)
    word = "language "
    seen = collections.Counter(tuple(model.encode(word, k).tolist()) for k in range(2000))
    assert len(seen) > 8  # in different documents
    one, many = model.encode(word[:-1], 7).tolist(), model.encode(word * 2000, 7).tolist()
    assert len(set("".join(model.raw[i].decode() + "|" for i in many).split(" "))) > 8  # and in one
    assert many[: len(one)] == one and many == pieces.Pieces(pieces.default_model(), 0.1).encode(word * 2000, 7).tolist()  # whatever is kept from before
    n = len(model.encode("a " * 20_000, 3))  # the one candidate of each word comes up once
    assert abs((n - 20_001) / 20_000 - 0.1) < 0.01
    assert len({tuple(model.encode("x" * 300, k).tolist()) for k in range(20)}) == 20


def test_pieces_query(docs):
    got = {r["doc_id"]: r for r in pieces.pieces_query(docs).collect()}
    model = pieces.Pieces(pieces.default_model())
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows) and all(r["lossless"] for r in got.values())
    assert all(got[d]["n_ids"] == len(model.encode(t, zlib.crc32(str(d).encode()))) for d, t in rows)


CLASH = ("keep", "p_text", "_s", "_id", "_key", "key", "spans", "_digest", "_copy", "secrets", "ids", "ROW")


@pytest.mark.parametrize("k", range(5))
def test_stages_with_odd_rows(spark, odd, k):
    """Nulls in any column, repeated rows, columns with the names that stages use inside, and no rows."""
    import corpus_pipeline as pipeline

    name, stage = pipeline.STAGES[k]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    rows = docs.unionByName(odd.select(docs.columns)).unionByName(docs.limit(3)).withColumns({c: F.lit(f"own {c}") for c in CLASH})
    out = stage(spark, rows, SF).collect()
    if name == "pieces":
        assert len(out) == rows.count() and all(r["lossless"] and r["n_ids"] == len(r["ids"]) for r in out)
    else:
        assert stage(spark, rows, SF).columns == rows.columns and all(r[c] == f"own {c}" for r in out for c in CLASH)
        same = lambda rs: collections.Counter((r["doc_id"], r["text"] if name != "secrets" else None) for r in rs)
        assert not same(out) - same(rows.collect())
        nulls = sum(r["text"] is None for r in rows.collect())
        if name in ("near-duplicates", "decontamination", "secrets"):
            assert sum(r["text"] is None for r in out) == nulls
    assert stage(spark, rows.limit(0), SF).count() == 0


def test_long_texts(spark):
    """Texts of 20,000 words and of two megabytes without a space."""
    rng = random.Random(9)
    words = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(20_000))
    docs = spark.createDataFrame([(1, words), (2, words[:-9] + " changed"), (3, "x" * 2_000_000)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.neardup_query(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert all(r["lossless"] for r in pieces.pieces_query(docs.where("doc_id < 3")).collect())
    assert {r["doc_id"]: r["n_bytes"] for r in telephony.telephony_query(docs).collect()} == {1: len(words), 2: len(words[:-9]) + 8, 3: 2_000_000}
    assert [r["n_tokens"] > 1 for r in tokens.token_query(docs).collect()] == [True] * 3
    assert licenses.license_query(docs).count() == secrets.secrets_query(docs).count() == 3


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert after.columns == docs.columns, name
        assert 0 < after.count() <= kept.count()
        kept = spark.createDataFrame(after.collect(), docs.schema)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert all(not secrets.find_secrets(t) for t in texts.values())
    got = {r["doc_id"]: r for r in pipeline.run(spark, SF).collect()}
    assert set(got) == set(texts) and all(r["lossless"] for r in got.values())
    model = pieces.load(pieces.default_model())
    assert all(model.decode(np.array(r["ids"])) == texts[d] for d, r in got.items())


def test_driver_gives_back_after_each_table(spark, monkeypatch):
    assert common.driver_gives_back(spark)
    real, said = common.driver_gives_back, []
    monkeypatch.setattr(common, "driver_gives_back", lambda s: said.append(real(s)))
    assert common.saved(common.saved(spark.range(3), "one"), "two").count() == 3
    assert said == [True, True]
