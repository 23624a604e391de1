"""Trained operators, secret scans and sampled pieces, against plain forms and held-out rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from gridsift.llm import catalog, labelled, language, measures, pieces, quality_gam, quality_rules, secrets
from gridsift.llm.words import mix, seeded
from tests.conftest import SF
from tests.llm.helpers import TEXTS, by_id, documents, words

LARGE = SF.replace("0.001", "0.01")


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def base_counts(text):
    text = text or ""
    found = words(text)
    windows = Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))
    covered = {j for i in range(len(found) - 4) if windows[tuple(found[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


LINES = ["a\na\n\n\nb\na", "\n\n", "x y\nx y\n x y", "a b c d e\na b c d e", "a b c d e f a b c d e f a b c d e", "q q q q q q q"]


def test_base_counts():
    texts = [*TEXTS, *LINES]
    got = measures.base_measures(pa.array(texts))[2]
    assert list(zip(*(got[c].tolist() for c in quality_rules.COUNTS), strict=True)) == [base_counts(t) for t in texts]


def test_quality_rules(spark):
    docs = documents(spark, [*TEXTS, *LINES], repeat=True)
    rows = quality_rules.quality(docs, None).collect()
    assert len(rows) == docs.count()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        want = base_counts(text[r["doc_id"]])
        assert tuple(r[c] for c in quality_rules.COUNTS) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r["base_failed"] == failed and r["kept"] == (not failed) and r["good"] == 1
    labels = spark.createDataFrame([], "doc_id long, quality int")
    kept = quality_rules.keep_good(docs, labels)
    assert kept.schema == docs.schema
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in rows if r["kept"])
    assert quality_rules.quality(documents(spark, empty=True), None).count() == 0
    assert quality_rules.keep_good(documents(spark, empty=True), labels).count() == 0


def test_quality_rules_learn(spark):
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    rows = by_id(catalog.QUERIES["op5_quality_rules"](spark, LARGE))
    assert len(rows) == docs.count()
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if held_out(r["doc_id"])}
    model = [(known[i], rows[i]["kept"]) for i in known if not rows[i]["base_failed"]]
    assert np.mean([kept == bool(q) for q, kept in model]) > 0.95
    assert all(kept for q, kept in model if q == 1)
    kept = quality_rules.keep_good(docs, labels)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, r in rows.items() if r["kept"]}


def test_linear_scores_are_means_of_weights():
    texts = ["ab cd", "", "abc", "é ab cd ab", None]
    words_, h, _ = measures.base_measures(pa.array(texts))
    weights = np.random.default_rng(1).normal(size=3 * quality_rules.SIZE)
    grams = quality_rules.n_grams(words_, h)
    assert [np.diff(e).tolist() for _, e in grams] == [[3, 0, 1, 9, 0], [2, 0, 1, 4, 0], [1, 0, 0, 3, 0]]
    alone = [quality_rules.linear_scores(quality_rules.n_grams(*measures.base_measures(pa.array([t], pa.string()))[:2]), weights)[0] for t in texts]
    assert np.allclose(quality_rules.linear_scores(grams, weights), alone)
    many = ["xyz " * 200_000, *texts]
    single = weights.astype(np.float32)
    late = quality_rules.linear_scores(quality_rules.n_grams(*measures.base_measures(pa.array(many))[:2]), single)[1:]
    assert np.allclose(late, quality_rules.linear_scores(grams, single), rtol=0, atol=1e-9)


def test_platt_gives_probabilities():
    rng = np.random.default_rng(2)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < labelled.sigmoid(2 * x - 1)).astype(int)
    a, b = labelled.platt(x, y, np.ones(4000))
    assert abs(a - 2) < 0.3 and abs(b + 1) < 0.3
    assert labelled.platt(np.zeros(0), np.zeros(0, int), np.zeros(0))


def test_label_sample(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, 1, 0), (3, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = labelled.label_sample(labels, "quality", 20, by_label=True).collect()
    assert Counter(r["label"] for r in rows) == {0: 20, 1: 20} and not any(held_out(r["id"]) for r in rows)
    assert len({r["id"] for r in rows}) == 40
    assert labelled.label_sample(labels, "quality", 1000).count() == sum(not held_out(i) for i in range(200))


def test_additive_model(spark):
    rows = by_id(catalog.QUERIES["op7_quality_scores"](spark, LARGE))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{LARGE}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(r["held_out"] == held_out(i) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows.values())
    checked = [(q, rows[i]["predicted"]) for i, q in labels.items() if held_out(i)]
    assert len(checked) > 50 and np.mean([q == p for q, p in checked]) > 0.95


def test_additive_model_on_odd_rows(spark):
    docs = documents(spark, repeat=True)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (99, None)], "doc_id long, quality int")
    rows = quality_gam.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 < r["score"] < 1 for r in rows)
    none = labels.where("false")
    assert {r["score"] for r in quality_gam.quality_scores(docs, none).collect()} == {0.5}
    assert quality_gam.quality_scores(documents(spark, empty=True), labels).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "a b")], "doc_id long, text string")
    assert [r["held_out"] for r in quality_gam.quality_scores(nulls, none).collect()] == [False, False]


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(4)
    x = rng.random((3000, len(quality_gam.FEATURES))).astype(np.float32)
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(int)
    model = quality_gam.fit_model(pd.DataFrame({"id": range(3000), "label": y, "features": list(x)}))
    assert (5, 2) in model["pairs"]
    assert np.mean((quality_gam.predict(model, x) > 0.5) == y) > 0.95
    slow = [labelled.sigmoid(model["start"] + sum(t[np.searchsorted(e, v, "right")] for e, t, v in zip(model["edges"], model["tables"], row, strict=True))
            + sum(t[np.searchsorted(model["coarse"][i], row[i], "right"), np.searchsorted(model["coarse"][j], row[j], "right")] for (i, j), t in model["pairs"].items())) for row in x[:50]]
    assert np.allclose(slow, quality_gam.predict(model, x[:50]))


def test_features_depend_on_the_text_alone():
    texts = [*TEXTS, *LINES]
    whole = quality_gam.features(pa.array(texts))
    assert whole.shape == (len(texts), len(quality_gam.FEATURES)) and np.isfinite(whole).all()
    for k, t in enumerate(texts):
        assert (quality_gam.features(pa.array([t], pa.string()))[0] == whole[k]).all()


SECRETS = [
    'Password : "abcdefgh1" token=short tOkEn=longenough9 api_key=AAAA1111bbbb apikey:zzzzzzzz ſecret=aaaaaaaaaa',
    "AKIAABCDEFGHIJKL AKIASHORT xAKIA0000000000001Z", "0123456789abcdef0123456789abcdef0 deadbeef " + "f" * 31, "é" * 5 + " secret='" + "s" * 40 + "'",
    "passwd=password=secret=token12345 passwordpassword:12345678", "ghp_" + "a" * 36 + " xoxb-123456789012 sk_live_" + "1" * 20,
    "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl -----BEGIN RSA PRIVATE KEY----- https://u:pass@host AIza" + "b" * 35, "akia", "to", "tok", "token=" * 9 + "abcdefgh",
]


def plain_spans(text):
    rules = [
        (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 8),
        (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 16),
        (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 32),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, flags, good) in enumerate(rules) for m in re.finditer(p, text or "", flags) if good(m))


@pytest.mark.parametrize("repeat", [False, True])
def test_secrets(spark, repeat):
    docs = documents(spark, [*TEXTS, *SECRETS], repeat=repeat)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = secrets.secrets(docs).collect()
    assert len(rows) == docs.count()
    kinds = ["assign", "access", "hex"]
    for r in rows:
        spans = plain_spans(text[r["doc_id"]])
        said = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert set(said.split(",")) - {""} <= set(r["spans"].split(","))
    found = Counter(x.split(":")[0] for r in rows for x in r["spans"].split(",") if x)
    assert {r.kind for r in (*secrets.BASE, *secrets.MORE)} <= set(found)
    assert secrets.secrets(documents(spark, empty=True)).count() == 0


def test_index_finds_what_a_full_scan_finds():
    import duckdb

    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{LARGE}/documents.parquet'").fetchall()] + SECRETS
    scanner = secrets.Scanner((*secrets.BASE, *secrets.MORE))
    plain = [secrets._found_by(r) for r in (*secrets.BASE, *secrets.MORE)]
    full = [sorted((a, k, b) for k, find in enumerate(plain) for a, b in find(t)) for t in texts]
    assert scanner.scan(pa.array(texts)) == full


def test_searches_match_as_their_patterns():
    import random

    rng = random.Random(8)
    rules = [r for r in secrets.MORE if r.find]
    parts = ["://", "http", "a", "1", ".", "-", ":", "@", "/", " ", "user", "pass", "eyJ", "abcdefgh", "_", "é", "A", "eyJabcdefgh.eyJabcdefgh.abcdefgh", "x://u:pwd@"]
    found = 0
    for _ in range(20000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 14)))
        for r in rules:
            got = list(r.find(text))
            assert got == list(secrets._found_by(r)(text)), (r.kind, text)
            found += len(got)
    assert len(rules) == 2 and found > 1000


@pytest.mark.parametrize("text", ["x://u:pwd@" + "a" * 2_000_000, "eyJ" * 700_000, "a-" * 1_000_000 + "://", "://" * 700_000, "eyJ." * 500_000, "token" * 400_000 + " " * 500_000, "a:" * 900_000 + "//", "-----BEGIN " + "A " * 900_000])
def test_texts_of_megabytes_take_time_by_their_length(text):
    import time

    scanner = secrets.Scanner((*secrets.BASE, *secrets.MORE))
    start = time.process_time()
    scanner.scan(pa.array([text, "x"]))
    assert time.process_time() - start < 3


def test_trigram_queries():
    query = lambda p, flags=0: secrets.trigram_query(secrets.Rule("x", p, flags=flags))
    assert query("abcd") == ("and", (b"abc", b"bcd")) and query("ab") is True and query("[a-z]+") is True
    assert query("ABC|xyz") == ("or", (b"abc", b"xyz")) and query("abc|x") is True
    assert query("ab?c+def") == ("and", (b"def",)) or query("ab?c+def") == b"def"
    assert query("(foo)*bar") == b"bar" and query("(foo)+[0-9]*") == b"foo"


def model_pieces():
    """Weights and ids of the pieces of the model file, marks as one byte, and the ids of single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=catalog.tokenizer("piece_bpe_32k.model"))
    weights, single = {}, {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            single[bytes([int(piece[3:5], 16)])] = i
        elif not (model.is_control(i) or model.is_unknown(i)):
            weights.setdefault(piece.encode().replace("▁".encode(), bytes([pieces.MARK])), (-float(np.log1p(i)), i))
    return weights, single


def plain_sample(weights, single, text, key, seed):
    """Forward filtering and backward sampling place by place, with the same draws.

    A run of marks and the word behind it are one chunk, cut further at bytes that are in no piece.
    """
    mark, data = pieces.MARK, bytes([pieces.MARK]) + (text or "").encode().replace(b" ", bytes([pieces.MARK]))
    inside = set(b"".join(weights))
    chunks, at = [], 0
    for k in range(1, len(data) + 1):
        if k == len(data) or (data[k] == mark and data[k - 1] != mark) or data[k] not in inside or data[k - 1] not in inside:
            chunks.append(data[at:k])
            at = k
    out = []
    for number, chunk in enumerate(chunks):
        ways, total = [[]], [0.0]
        for end in range(1, len(chunk) + 1):
            own = []
            for s in range(end - 1, -1, -1):
                piece = chunk[s:end]
                if piece in weights:
                    own.append((weights[piece][0] + total[s], weights[piece][1], end - s))
                elif len(piece) == 1:
                    own.append((pieces.BYTE_WEIGHT + total[s], single[piece], 1))
            total.append(float(np.log(sum(np.exp(w[0]) for w in own))))
            ways.append([(np.exp(w[0] - total[-1]), w[1], w[2]) for w in own])
        noise = mix(seeded(np.array([key], np.int64).view(np.uint64), seed) + mix(np.array([number], np.uint64)))
        drawn, end, step = [], len(chunk), 0
        while end:
            step += 1
            u, upto = float(seeded(noise, step)[0] >> np.uint64(11)) * 2.0**-53, 0.0
            for share, way, length in ways[end]:
                upto += share
                if upto > u:
                    break
            drawn.append(int(way))
            end -= length
        out += drawn[::-1]
    return out


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattice(catalog.tokenizer("piece_bpe_32k.model"))


ODD = ["▁ a▁b ▁", "  two  spaces ", "\x00\x01", "línea\nnueva\r\n\tñ", "𝔘𝔫𝔦 😀😀", "<0x41> <s> </s> <unk>", "anti" * 40]


def test_pieces_sample_as_the_plain_form(lattice):
    texts = [t for t in [*TEXTS, *ODD] if len(t or "") < 3000]
    keys = np.arange(len(texts)) * 7 - 3
    ids, counts = lattice.encode(pa.array(texts), keys, 5)
    ends = np.cumsum(counts)
    weights, single = model_pieces()
    for k, t in enumerate(texts):
        assert ids[ends[k] - counts[k] : ends[k]].tolist() == plain_sample(weights, single, t, int(keys[k]), 5)


def test_pieces_are_sampled_by_weight(lattice):
    n = 20000
    ids, counts = lattice.encode(pa.array(["the"] * n), np.arange(n))
    ends = np.cumsum(counts)
    found = Counter(tuple(ids[e - c : e].tolist()) for e, c in zip(ends, counts, strict=True))
    chunk, weights = bytes([pieces.MARK]) + b"the", defaultdict(float)

    def walk(at, way, weight):
        if at == len(chunk):
            weights[way] += np.exp(weight)
        for end in range(at + 1, len(chunk) + 1):
            if chunk[at:end] in lattice.known:
                i, w = lattice.known[chunk[at:end]]
                walk(end, (*way, i), weight + w)

    walk(0, (), 0.0)
    total = sum(weights.values())
    assert set(found) <= set(weights) and len(found) > 2
    for way, w in weights.items():
        p = w / total
        assert abs(found[way] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4


def test_pieces_round_trip(spark):
    docs = documents(spark, [*TEXTS, *ODD], repeat=True)
    model = catalog.tokenizer("piece_bpe_32k.model")
    rows = pieces.encode(docs, model)
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    back = pieces.decode(rows, model).collect()
    assert len(back) == docs.count() and all(r["text"] == text[r["doc_id"]] for r in back)
    first = {r["doc_id"]: r for r in rows.collect()}
    assert all(r == first[r["doc_id"]] for r in pieces.encode(docs.repartition(7), model).collect())
    for i, r in first.items():
        assert r["n_pieces"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert r["decoded_crc32"] == zlib.crc32(text[i].encode())
    assert pieces.encode(documents(spark, empty=True), model).count() == 0
    nulls = spark.createDataFrame([(1, None), (None, [])], "doc_id long, ids array<int>")
    assert [r["text"] for r in pieces.decode(nulls, model).collect()] == ["", ""]


def test_neighbours_do_not_change_samples(lattice):
    fresh = pieces.Lattice(catalog.tokenizer("piece_bpe_32k.model"))
    texts, keys = pa.array(TEXTS), np.arange(len(TEXTS))
    want = lattice.encode(texts, keys)[0]
    assert (fresh.encode(texts.slice(6, 3), keys[6:9])[0] is not None) and (fresh.encode(texts, keys)[0] == want).all()


def plain_language_model(texts):
    """Probability of a character after three others, by the recursion of the definition."""
    counts = [Counter() for _ in range(language.ORDER + 1)]
    for t in texts:
        s = "   " + t
        for i in range(3, len(s)):
            counts[4][s[i - 3 : i + 1]] += 1
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    alphabet = {c for g in counts[4] for c in g}

    def p(gram, size):
        n = len(gram)
        if n == 0:
            return 1 / (size + 1)
        low = p(gram[1:], size)
        same = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        if not same:
            return low
        total = sum(same.values())
        return max(same.get(gram, 0) - 0.75, 0) / total + 0.75 * len(same) / total * low

    return p, alphabet


def test_language_models_follow_the_definition():
    train = {"en": ["the cat sat on the mat", "then that"], "de": ["der hund und die katze", "das und"]}
    rows = []
    for lang, texts in train.items():
        batch = pa.record_batch([pa.array([lang] * len(texts)), pa.array(texts)], ["lang", "text"])
        rows += [r for b in language._counts(iter([batch])) for r in b.to_pylist()]
    frame = pd.DataFrame(rows).assign(gram=lambda f: f["gram"].map(tuple)).groupby(["lang", "gram"], as_index=False)["n"].sum()
    model = language.fit_models(frame)
    models = {lang: plain_language_model(texts) for lang, texts in train.items()}
    size = len(set().union(*(m[1] for m in models.values())))
    texts = ["the hund", "xyz the", "und that katze", ""]
    entropy, n = language.cross_entropies(model, pa.array(texts))
    assert n.tolist() == [len(t.replace(" ", "")) for t in texts]
    for k, t in enumerate(texts):
        for j, lang in enumerate(model["names"]):
            s = "   " + t
            want = -np.mean([np.log(models[lang][0](s[i - 3 : i + 1], size)) for i in range(3, len(s))]) if t else 0
            assert abs(entropy[k, j] - want) < 1e-4


def test_prepared_text():
    chars, edges, n = language.prepared(pa.array(["  A1b  C!", "", None, "é\nÉ ", "12"]))
    got = ["".join(map(chr, chars[edges[k] : edges[k + 1]])) for k in range(5)]
    assert got == ["   a b c ", "   ", "   ", "   é é ", "   "] and n.tolist() == [3, 0, 0, 2, 0]


def test_languages(spark):
    rows = by_id(catalog.QUERIES["op10_language"](spark, LARGE))
    docs = spark.read.parquet(f"{LARGE}/documents.parquet").collect()
    assert len(rows) == len(docs)
    checked = [(r["lang"], rows[r["doc_id"]]["lang_pred"]) for r in docs if held_out(r["doc_id"])]
    assert np.mean([a == b for a, b in checked]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["held_out"] == held_out(i) for i, r in rows.items())


def test_languages_of_odd_rows(spark):
    docs = documents(spark, repeat=True)
    model = language.train(docs)
    assert model["names"] == ["en"]
    rows = language.languages(docs, model).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        some = any(c.isalpha() for c in text[r["doc_id"]] or "")
        assert r["lang_pred"] == ("en" if some else "und") and (r["score"] > 0) == some
    empty = documents(spark, empty=True)
    assert language.train(empty) is None
    assert {r["lang_pred"] for r in language.languages(docs, None).collect()} == {"und"}
    assert language.languages(empty, model).count() == 0


def test_least_hashes_of_a_task():
    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"id": np.arange(5000), "lang": rng.choice(["a", "b", "c"], 5000, p=[0.9, 0.09, 0.01]), "key": rng.integers(-50, 50, 5000)})
    (got,) = language._least(60)(iter([rows[:1700], rows[1700:1700], rows[1700:]]))
    want = rows.sort_values(["key", "id"]).groupby("lang").head(60)
    assert set(got["id"]) == set(want["id"]) and (got.groupby("lang").size() <= 60).all()
    assert not list(language._least(60)(iter([])))
