"""Clustering, SentencePiece and phrases against plain Python and the library."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import sentencepiece as spm
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb

from factloom.llm import centroids, langid, phrases, pieces, piecewise, quality, secret_scan
from factloom.llm.common import ready

DOCS = "doc_id bigint, text string, lang string"


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    ready(spark)


# --- clustering ---------------------------------------------------------------


def cluster_by_hand(rows, k, rounds, dims):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(x) * 1024 if abs(x) >= 2.0**52 else int(np.floor(x * 1024)) for x in v]))
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", [str(x) for x in r[1]]))
    cents = [v for _, v in first[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        cents = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if groups[n] else c for n, c in enumerate(cents)]
    placed = [(i, *near(v)[::-1]) for i, v in kept]
    total = collections.Counter()
    for _, c, d in placed:
        total[c] += d
    fit = lambda x: x if x < 1 << 63 else None
    mark = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, fit(d), fit(total[c]), fit(sum(total.values())), mark[c]) for i, c, d in placed), key=str)


def clustered(spark, rows, kind="double", **how):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").withColumns({"cluster": F.lit("x"), "id": F.lit(1), "vec": F.lit(2), "distance": F.lit(0)})
    return sorted((tuple(r) for r in centroids.cluster(df.repartition(3), **how).drop("checked").collect()), key=str)


@pytest.mark.parametrize("scale", [0.2, 0.003, 1e9, 1e300])
def test_clusters_equal_plain_rounds(spark, scale):
    rng = random.Random(str(scale))
    rows = [(i, [rng.gauss(rng.choice([-1, 1]), 1) * scale for _ in range(4)]) for i in range(150)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, [0.0] * 4), (900, None), (901, []), (902, [1.0, None, 1.0, 1.0]), (903, [float("nan")] * 4), (904, [float("inf")] * 4), (905, [1.0] * 5)]
    rows += [(1000 + i, [0.5 * scale] * 4) for i in range(60)]  # a hot vector
    assert clustered(spark, rows, k=5, rounds=4, dims=4) == cluster_by_hand(rows, 5, 4, 4)


def test_few_and_no_vectors(spark):
    rows = [(1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, [-2.0, 0.0])]
    assert clustered(spark, rows, kind="float", k=8, rounds=3, dims=2) == cluster_by_hand(rows, 8, 3, 2)
    assert clustered(spark, [], k=8, rounds=3, dims=2) == [] and clustered(spark, [(1, None)], dims=2) == []


def test_walk_stops_early_and_keeps_ties():
    rng = np.random.default_rng(4)
    cents = rng.integers(-3, 4, (40, 3)).tolist()
    rows = rng.integers(-4, 5, (500, 3))
    own, best, checked = centroids.Lists(cents).nearest(rows)
    every = ((rows[:, None, :] - np.array(cents)[None]) ** 2).sum(axis=2)
    assert (own == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    spread = [[100 * i, 100 * i, 100 * i] for i in range(40)]
    assert centroids.Lists(spread).nearest(np.array([[210, 205, 190]]))[2][0] < 5
    assert checked.max() <= 40


# --- SentencePiece -------------------------------------------------------------


def plain_model():
    with open(pieces.model_path(), "rb") as f:
        return model_pb.ModelProto.FromString(f.read())


def variant(rule, squeeze, dummy, fallback):
    model, spec = plain_model(), model_pb.NormalizerSpec()
    spec.ParseFromString(spm.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
    model.normalizer_spec.precompiled_charsmap = spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.add_dummy_prefix = squeeze, dummy
    model.trainer_spec.byte_fallback = fallback
    if not fallback:
        for p in model.pieces:
            if p.type == pieces.BYTE:
                p.type, p.piece = pieces.NORMAL, "QQ" + p.piece
    return model.SerializeToString()


POOL = "  " * 4 + "\n\t▁　​ abcdeXYZÄéﬁ①㍿ＡＢ가각が゜ㇰ½…™ªº²́̈Å;ΩＡ％😀中文<s></s>.,0"


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze, dummy, fallback", [(False, True, True), (True, True, True), (True, False, False), (False, False, False)])
def test_pieces_spans_and_text_equal_the_library(rule, squeeze, dummy, fallback):
    blob = variant(rule, squeeze, dummy, fallback)
    ours, back, library = pieces.Encoder(blob), pieces.Decoder(blob), spm.SentencePieceProcessor(model_proto=blob)
    rng = random.Random(rule)
    texts = ["", " ", "   ", "▁", "<unk>", "hello  world ", "word " * 300] + ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    for t in texts:
        ids, begins, ends = ours.encode(t)
        want = library.encode(t, return_type="proto").pieces
        assert list(zip(ids.tolist(), begins.tolist(), ends.tolist(), strict=True)) == [(p.id, p.begin, p.end) for p in want], t
        assert back.decode(ids) == library.decode(ids.tolist())


def test_any_ids_decode_as_the_library_does():
    ours, library = pieces.decoder(pieces.model_path()), spm.SentencePieceProcessor(model_file=pieces.model_path())
    rng = random.Random(8)
    for _ in range(500):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(270) for _ in range(rng.randint(0, 9))]
        assert ours.decode(np.array(ids, dtype=np.int64)) == library.decode(ids)


def test_models_of_other_kinds_are_refused():
    model = plain_model()
    model.trainer_spec.model_type = model_pb.TrainerSpec.UNIGRAM
    with pytest.raises(ValueError):
        pieces.Encoder(model.SerializeToString())


def test_words_in_use_stay_remembered(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 4)
    ours, library = pieces.Encoder(plain_model().SerializeToString()), spm.SentencePieceProcessor(model_file=pieces.model_path())
    text = " ".join(f"w{i % 7}x{i}" for i in range(200)) + " w w w"
    assert ours.encode(text)[0].tolist() == library.encode(text) and len(ours.known) <= 5


def test_pieces_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(pieces, "SLICE", 1000)
    rows = [(1, "Über  all\n", "a"), (1, "Über  all\n", "a"), (2, None, None), (3, "", "c"), (None, "x" * 60_000, "d"), (5, "a b " * 20_000, "e")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").withColumn("Decoded", F.lit(3)).withColumn("c1", F.lit("c"))
    library = spm.SentencePieceProcessor(model_file=pieces.model_path())
    encoded = pieces.encode_texts(df)
    assert encoded.columns == ["doc_id", "text", "Decoded", "c1", "ids", "begins", "ends"]
    decoded = pieces.decode_ids(encoded)
    assert decoded.columns == ["doc_id", "text", "c1", "ids", "begins", "ends", "decoded"]
    got = sorted(((r.doc_id, r.text, list(r.ids), r.decoded) for r in decoded.collect()), key=str)
    assert got == sorted(((i, t, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, _ in rows), key=str)
    assert decoded.filter("c1 <> 'c'").count() == 0
    assert pieces.decode_ids(spark.createDataFrame([(1, None)], "k int, ids array<int>")).first().decoded == ""
    assert pieces.encode_texts(df.limit(0)).collect() == []


# --- phrases ---------------------------------------------------------------------


def phrases_by_hand(rows, top, least, longest):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, total = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    count[lang or "und"][tuple(words[i : i + m])] += 1
    out = []
    for lang, found in count.items():
        n = total[lang]
        inside = set()
        for p, a in found.items():
            if len(p) > 2 and a >= least:
                for m in range(2, len(p)):
                    inside |= {q for i in range(len(p) - m + 1) if a >= found[q := p[i : i + m]]}
        ranked = []
        for p, a in found.items():
            if 1 < len(p) and a >= least and p not in inside:
                score, _, left, right = min((1000 * a * n // (found[p[:k]] * found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r + 1, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


def phrase_rows(seed, docs=60):
    rng = random.Random(seed)
    vocabulary = [rng.choice("abcdefgh") * rng.randint(1, 2) + str(i % 9) for i in range(25)] + ["THE", "the", "Ärzte", "ärzte", "\x1cx", "\xa0y", "\0z"]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 9))) for _ in range(6)]
    rows = []
    for i in range(docs):
        text = "".join(rng.choice([rng.choice(passages), rng.choice(vocabulary) + rng.choice([" ", "  ", "\t", "\n", ". ", ",", "!", "\r\n", "\x0b"])]) + rng.choice(["", " ", ";"]) for _ in range(rng.randint(0, 30)))
        rows.append((i, text, rng.choice(["en", "en", "en", "fr", None, "und"])))
    return rows + [(900, None, "en"), (901, "", "de"), (902, "   . ", "de"), (903, "a a a a a a a a a a", "one"), (1, rows[1][1], rows[1][2])] + [(1000 + i, passages[0], "hot") for i in range(40)]


@pytest.mark.parametrize("top, least, longest, bits", [(7, 5, 5, None), (2000, 3, 4, None), (3, 10, 5, 1 << 9), (1, 4, 2, 1 << 20)])
def test_phrases_equal_full_counts(spark, monkeypatch, top, least, longest, bits):
    monkeypatch.setattr(phrases, "BITS", bits or phrases.BITS)
    rows = phrase_rows(top)
    df = spark.createDataFrame(rows, DOCS).withColumns({"phrase": F.lit("p"), "rank": F.lit(1), "f": F.lit("q")}).repartition(4)
    got = sorted(tuple(r) for r in phrases.collocations(df, top=top, least=least, longest=longest).collect())
    want = phrases_by_hand(rows, top, least, longest)
    assert want and got == want


def test_no_phrases(spark):
    empty = spark.createDataFrame([], DOCS)
    assert phrases.collocations(empty).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, "a b c", "en"), (2, None, None)], DOCS)).collect() == []


def test_exact_products_beyond_64_bits(spark):
    rows = [("en", 8 * 10**9, 3 * 10**11, 7 * 10**9, 9 * 10**9)]
    got = spark.createDataFrame(rows, "lang string, a long, n long, l long, r long").select(phrases._score("a", "n", "l", "r").alias("s")).first().s
    assert got == 1000 * 8 * 10**9 * 3 * 10**11 // (7 * 10**9 * 9 * 10**9)


# --- corrections to earlier operators ----------------------------------------------


def test_a_language_of_few_texts_is_learned(spark):
    rng = random.Random(30)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(3, 8)))
    french = [" ".join(word("éèàçœuioa") for _ in range(40)) for _ in range(5)]
    english = [" ".join(word("thenrsdl") for _ in range(40)) for _ in range(500)]
    rows = [(i, french[i % 5], "fr") for i in range(4000)] + [(9000 + i, t, "en") for i, t in enumerate(english)]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.fit(docs.select("text", "lang"))
    assert set(model.langs) == {"en", "fr"}
    found = {(r.lang, r.lang_pred) for r in docs.select("doc_id", "lang").join(langid.identify(docs, model), "doc_id").collect()}
    assert found == {("fr", "fr"), ("en", "en")}


def test_language_equals_plain_centroids(spark):
    """The same centroids and cosines in plain Python, from dictionaries of n-grams."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 3000")
    model = langid.fit(docs.select("text", "lang"), sample=15)
    rows = docs.select("doc_id", "text", "lang").collect()
    by_lang = collections.defaultdict(set)
    for r in rows:
        if r.lang and r.text:
            by_lang[r.lang].add(r.text)
    assert set(model.langs) <= set(by_lang)

    def weights(text):
        counts = langid.gram_counts(text)
        if counts is None:
            return None
        found = {i: np.log1p(c) * model.idf[i] for i, c in enumerate(counts) if c}
        norm = sum(x * x for x in found.values()) ** 0.5
        return {i: x / norm for i, x in found.items()}

    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for r in rows[:60]:
        own = weights(r.text or "")
        if own is None:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        cosines = [sum(x * float(c[i]) for i, x in own.items()) for c in model.centres]
        assert abs(got[r.doc_id].score - max(cosines)) < 1e-4
        assert got[r.doc_id].lang_pred in {lang for lang, c in zip(model.langs, cosines, strict=True) if c > max(cosines) - 1e-4}


def test_site_posteriors_equal_plain_sums(spark):
    rng = random.Random(31)
    rows = [(i, i, f"h{rng.randrange(4)}", f"p{rng.randrange(3)}", rng.uniform(-4, 4), rng.uniform(-6, 1)) for i in range(400)] + [(500, 1, "lone", "p", 3.0, -1.0)]
    scored = spark.createDataFrame(rows, "doc_id bigint, digest bigint, host string, path string, low double, toxic double")
    sites = quality.site_posteriors(scored)
    first = sites.first()
    got = {r.doc_id: r for r in scored.join(sites, ["host", "path"]).select("doc_id", *[quality.others_rate(t).alias(t) for t in quality.TARGETS]).collect()}
    rate = lambda x: 1 / (1 + np.exp(-x))
    for col, t in ((4, "low"), (5, "toxic")):
        world = np.mean([rate(r[col]) for r in rows])
        k_host, k_path = first[f"k_host_{t}"], first[f"k_path_{t}"]
        assert abs(first[f"world_{t}"] - world) < 1e-9 and 1 <= k_host <= 1e4
        for r in rows:
            host = [rate(x[col]) for x in rows if x[2] == r[2] and x[0] != r[0]]
            path = [rate(x[col]) for x in rows if x[2:4] == r[2:4] and x[0] != r[0]]
            above = (sum(host) + k_host * world) / (len(host) + k_host)
            assert abs(got[r[0]][t] - (sum(path) + k_path * above) / (len(path) + k_path)) < 1e-9


def test_allow_words_fill_whole_segments(spark):
    hot = "Zx8QkP2mVb7TnR4cLw9Yd3Hs"
    cases = {f"/releases/latest/{hot}": True, f"latest-{hot}": True, f"/newest/{hot}": True, f"/test/{hot}": False, f"{hot}-example": False, f"contest_{hot}": True, f"abcdefghij{hot}": False}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id bigint, text string")
    got = {r.doc_id: "entropy_base64" in r.spans for r in secret_scan.secret_report(df).collect()}
    assert got == dict(enumerate(cases.values()))


def fingerprint_by_hand(text):
    """Rolling sums, cuts and piece hashes, one byte after another."""
    data, full = text.encode(), 0xFFFFFFFF
    if not data:
        return "2::"
    roll = []
    for i in range(len(data)):
        h = sum(data[i - b] * pow(0x01000193, b, 1 << 32) for b in range(min(7, i + 1))) & full
        for shift, factor in ((15, 0x2C1B3C6D), (12, 0x297A2D39)):
            h = (h ^ h >> shift) * factor & full
        roll.append(h ^ h >> 15)
    cuts = lambda k: [i for i, h in enumerate(roll) if h % (1 << k) == (1 << k) - 1]
    k = 1
    while (64 << k) < len(data):
        k += 1
    low = max(1, k - 2)
    while k > low and len(cuts(k)) < 32:
        k -= 1

    def signature(ends):
        out, piece, letters = "", [], "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
        for i, h in enumerate(roll):
            piece.append(h)
            if i in ends or i == len(roll) - 1:
                out += letters[(sum(piece) * 0x9E3779B1 & full) >> 26]
                piece = []
        return out

    return f"{1 << k}:{signature(set(cuts(k)))}:{signature(set(cuts(k + 1)))}"


def test_fingerprints_equal_a_plain_rolling_hash():
    rng = random.Random(51)
    for n in (0, 1, 2, 6, 7, 8, 50, 129, 700, 3000, 9000):
        text = "".join(rng.choice("abcdé ü\n") for _ in range(n))
        assert piecewise.fingerprint(text) == fingerprint_by_hand(text), n


def test_runs_stay_below_their_bound(spark, monkeypatch):
    monkeypatch.setattr(piecewise, "MOST_RUNS", 3)
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    assert piecewise.runs_with_next(docs, 5).agg(F.max("run")).first()[0] <= 2
    whole = sorted(tuple(r) for r in piecewise.edited_fingerprints(docs, 5).collect())
    monkeypatch.undo()
    assert whole == sorted(tuple(r) for r in piecewise.edited_fingerprints(docs, 5).collect()) and len(whole) == 100


def test_inner_names_never_clash(spark):
    import corpus_pipeline

    names = ["_own_digest", "_kept_id", "_bad_id", "_first", "_after", "_digest", "_hex", "_base", "_spans", "digest", "n", "root", "runs", "count"]
    rows = [(i, f"some words number {i} and token = Zx8QkP2mVb7TnR4cLw9Yd3Hs", "en", "a", 5) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({n: F.lit(f"own {n}") for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert all(r[n] == f"own {n}" for n in names), name
