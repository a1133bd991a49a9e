"""The training-data operators against libraries, brute force and planted cases."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, models, pre_tokenizers

import corpus_pipeline
from vectab.llm import embed_dedup, langid, lattice, minhash, packing, pii, piece_codec, quality, queries, sharding, token_count

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SIGNS = "   \n\t.,.,'s't aAbBcdeéßñÉΣİ日本語the ingtion0123456789.,!?-_<|endoftext|>́😀한국어αβγДж 　=*#\\{}()\x0b\x0c\x1c\x85\xa0▁"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "a null key"), (None, None),
    (5, "word " * 20_000), (6, "x" * 5_000), (7, "ab\n" * 40), (8, "日本語 テキスト"), (9, "1 2 3 !"),
]


def strange(seed, n, signs=SIGNS):
    rng = random.Random(seed)
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with extra columns whose names the operators use themselves."""
    schema = "doc_id bigint, text string, lang string, kept boolean, node bigint, _decision string, N_WORDS int"
    return spark.createDataFrame([(k, t, None, None, None, None, None) for k, t in ODD], schema).cache()


def operators():
    yield "quality", quality.quality_rules
    yield "packing", lambda d: packing.pack_documents(d, WORD_BPE)
    yield "language", lambda d: langid.identify(d, langid.fit_model(d))
    yield "minhash", minhash.near_duplicates
    yield "count", lambda d: token_count.count_tokens(d, queries.unigram_pieces())
    yield "shard", sharding.shard
    yield "codec", lambda d: piece_codec.encode_texts(d, PIECES)
    yield "lattice", lambda d: lattice.score_texts(d, piece_codec.read_pieces(PIECES))


@pytest.mark.parametrize("name,apply", list(operators()))
def test_odd_rows(odd, name, apply):
    rows = apply(odd).collect()
    found = Counter(r["doc_id"] for r in rows)
    wanted = Counter(k for k, _ in ODD)
    if name == "packing":
        assert set(found) == set(wanted) and all(found[k] >= n for k, n in wanted.items())
    else:
        assert found == wanted
    assert apply(odd.limit(0)).collect() == []


def test_pii_keeps_rows(odd):
    out = pii.pseudonymise(odd)
    assert out.columns == odd.columns
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, odd.collect()))


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]])
def test_stage_keeps_columns(spark, odd, stage):
    assert stage(spark, odd, "").columns == odd.columns
    assert stage(spark, odd.limit(0), "").collect() == []


def brute_quality(text):
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if w]

    def covered(n):
        seen = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        return {p for i in range(len(words) - n + 1) if seen[tuple(words[i : i + n])] > 1 for p in range(i, i + n)}

    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(covered(8)),
            *[sum(len(words[p]) for p in covered(n)) for n in quality.GRAM_SHARES])


def test_quality_brute():
    texts = [*strange(1, 200), *strange(2, 200, "ab ab \n"), None, "", "a b c d e f g h i j k " * 9, "é " * 40]
    got = quality.measure(pd.Series(texts))
    names = ["n_words", "word_chars", "n_symbols", "n_repeat_words", *[f"gram_chars_{n}" for n in quality.GRAM_SHARES]]
    assert [tuple(r) for r in got[names].itertuples(index=False)] == [brute_quality(t) for t in texts]


def test_packing_ids():
    texts = strange(3, 3000) + ["<|endoftext|>a <|ENDOFTEXT|>", "it's I'LL. a., b.c", ""]
    mine = packing.WordTokenizer(WORD_BPE)(texts)
    theirs = Tokenizer.from_file(WORD_BPE).encode_batch(texts, add_special_tokens=False)
    assert [m.tolist() for m in mine] == [t.ids for t in theirs]


def brute_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b >= n]
        if fits:
            bins[bins.index(min(fits))] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 64, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 400))]
    counts, spot = Counter(lengths), defaultdict(list)
    table = packing.plan(dict(counts), capacity)
    for n, c in counts.items():
        own = table[table[:, 0] == n]
        for rank in range(c):
            _, first, bin_, offset, each = own[np.searchsorted(own[:, 1], rank, side="right") - 1]
            spot[bin_ + (rank - first) // each].append((offset + (rank - first) % each * n, n))
    left = []
    for pieces in spot.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        left.append(capacity - at)
    assert sorted(left) == brute_best_fit(lengths, capacity)


def test_packed_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack_documents(docs, WORD_BPE).collect()
    tokenizer, ids = Tokenizer.from_file(WORD_BPE), defaultdict(dict)
    for r in rows:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        ids[r["doc_id"]][r["start"]] = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
    for d in docs.collect():
        whole = [i for _, part in sorted(ids[d["doc_id"]].items()) for i in part]
        assert whole == tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [0]
    spots = defaultdict(list)
    for r in rows:
        spots[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in spots.values():
        ends = [0, *np.cumsum([n for _, n in sorted(pieces)]).tolist()]
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 2048


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    rows = langid.identify(docs, langid.fit_model(docs)).join(docs, "doc_id").filter("held_out").select("lang", "lang_pred", "accepted").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    assert np.mean([r["accepted"] for r in rows]) > 0.98


def test_language_und():
    model = langid.fit(["the cat", "der hund"] * 20, ["en", "de"] * 20)
    got = langid.Predictor(model)(pd.Series([None, "", "123 !?", "the", "der hund ist"]))
    assert got.lang_pred.tolist()[:3] == ["und"] * 3 and not got.accepted[:3].any()
    assert got.lang_pred.tolist()[3:] == ["en", "de"] and got.score.between(0, 1).all()


def shingles(text, size):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\v\f\r" else c for c in text or "").split(" ")
    words = [w for w in words if w]
    n = min(size, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


@pytest.mark.parametrize("block", [4, minhash.BLOCK])
def test_minhash_planted(spark, monkeypatch, block):
    """A chain of near copies, copies of one text, and a crowd that shares a passage, against all pairs."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocab) for _ in range(120)]
    rows, doc = [], base[:]
    for k in range(40):
        rows.append((100 + k, " ".join(doc)))
        doc = doc[:]
        for _ in range(2):
            doc[rng.randrange(len(doc))] = rng.choice(vocab)
    rows += [(k, "Same Text of Copies") for k in (9, 7, 8)] + [(3, None), (4, ""), (5, "one"), (6, "ONE")]
    passage = " ".join(rng.choice(vocab) for _ in range(80))
    rows += [(500 + k, passage + " " + " ".join(rng.choice(vocab) for _ in range(30))) for k in range(60)]
    for size in (2, 5):
        sets = {k: shingles(t, size) for k, t in rows}
        root = {k: k for k, _ in rows}

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    root[max(find(a), find(b))] = min(find(a), find(b))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r["doc_id"]: tuple(r)[1:] for r in minhash.near_duplicates(docs, size=size).collect()}
        assert got == {k: (len(sets[k]), find(k), find(k) == k) for k in sets}
        kept = sorted(r["doc_id"] for r in minhash.keep_one(docs, size=size).collect())
        assert kept == sorted(k for k in sets if find(k) == k)


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        both = int(400 * share)
        values = rng.integers(0, 2**63, 800 - both).astype(np.uint64)
        a, b = minhash.fast_sketch(np.sort(values[:400])), minhash.fast_sketch(np.sort(values[400 - both :]))
        assert abs((a == b).mean() - both / (800 - both)) < 0.12
    assert len(minhash.fast_sketch(np.array([5], dtype=np.uint64))) == minhash.WIDTH


def test_vectors_brute(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 64))
    x = [*base, *(base[0] + 0.2 * rng.normal(size=(50, 64))), base[1], 3 * base[1], *rng.normal(size=(200, 64))]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(900, None, 0), (901, [0.0] * 64, 0), (902, [float("nan")] * 64, 1), (903, [None] * 64, 1), (904, [], 1), (905, [1.0, 2.0], 1)]
    schema = "vec_id long, embedding array<double>, kept int"
    got = {r["vec_id"]: tuple(r)[1:] for r in embed_dedup.near_vectors(spark.createDataFrame(rows, schema)).collect()}
    unit = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    comp = np.arange(len(x))
    for _ in range(len(x)):
        comp = np.array([comp[near[i]].min() for i in range(len(x))])
    want = {i: (int(near[i].sum()) - 1, int(comp[i]), bool(comp[i] == i)) for i in range(len(x))}
    want.update({k: (0, k, True) for k in range(900, 906)})
    assert got == want
    assert embed_dedup.near_vectors(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("bytes_too", [True, False])
def test_counts_as_tokenizer(bytes_too):
    pieces = queries.unigram_pieces()
    pieces = pieces if bytes_too else pieces[:3] + pieces[300:3000]
    theirs = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=bytes_too))
    theirs.pre_tokenizer = pre_tokenizers.Metaspace("▁", prepend_scheme="always", split=True)
    count, texts = token_count.UnigramCounter(pieces), strange(4, 2000) + ["", " ", "aaa"]
    assert [count(t) for t in texts] == [len(c.ids) for c in theirs.encode_batch(texts)]


def test_sharding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.union(docs.limit(1)).union(docs.filter("doc_id = 3")).union(docs.filter("doc_id = 3"))
    rows = sharding.shard(docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    slots = defaultdict(list)
    for r in rows:
        assert (r["size"], r["text_crc32"]) == (len(text[r["doc_id"]]) + 8, zlib.crc32(text[r["doc_id"]]))
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    sizes = [len(slots[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1


def test_bounded_loads_move_little():
    """A hot arc spills clockwise only, and keys at home stay while their shard has room."""
    _, owner = sharding.ring(8, 16)
    counts = np.full(len(owner), 10)
    counts[5] = 2000
    table = sharding.bounded_loads(counts, owner, 8)
    taken = np.zeros(8, dtype=int)
    for arc in range(len(owner)):
        own = table[table[:, 0] == arc]
        ends = [*own[1:, 1], counts[arc]]
        for (_, first, s, slot), end in zip(own, ends):
            taken[s] += end - first
    assert taken.sum() == counts.sum() and taken.max() - taken.min() <= 1
    assert all(len(table[table[:, 0] == a]) == 1 and table[table[:, 0] == a][0, 2] == owner[a]
               for a in range(len(owner)) if owner[a] != owner[5])


def test_codec_as_library(monkeypatch):
    library, codec = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.PieceCodec(piece_codec.vocabulary(PIECES))
    texts = strange(6, 3000) + [" " * k + w for k in range(40) for w in ("", "a", "日", "the", "=")] + [None, ""]
    texts += [t.replace(" ", "") for t in strange(7, 500)] + [" ".join(strange(8, 300, "abc.,  \n"))]
    for long in (piece_codec.LONG, 50):  # whole, and cut before runs of blanks
        monkeypatch.setattr(piece_codec, "LONG", long)
        ids = codec.encode(texts)
        assert [i.tolist() for i in ids] == [library.encode(t or "") for t in texts]
        assert codec.decode(ids) == [library.decode(i.tolist()) for i in ids]
        assert codec.listed(ids) == [",".join(map(str, i.tolist())).encode() for i in ids]


def test_lattice_sums_all_segmentations():
    pieces = piece_codec.read_pieces(PIECES)
    lat = lattice.Lattice(pieces)
    logp, ids = np.log(lat.prior), {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 1}

    def brute(word):
        if not word:
            return 1.0
        total = sum(lat.prior[ids[word[:k]]] * brute(word[k:]) for k in range(1, len(word) + 1) if word[:k] in ids)
        if word[0] not in ids:
            total += math.prod(lat.prior[lat.byte_ids[b]] for b in word[0].encode()) * brute(word[1:])
        return total

    words = ["the", "ing", "thereof", "", "日本", "x𓀀y", "zzzz"]
    for part, signs in lattice._by_length(words):
        edges = lat.edges(signs)
        for i, value in zip(part, lat.forward(edges, logp)[-1]):
            assert value == pytest.approx(math.log(brute("▁" + words[i])), rel=1e-9)
        weight = np.ones(len(part))
        lengths = lat.expected(edges, logp, weight) @ np.array([len(p) if kind == 1 else 0 for p, _, kind in pieces])
        plain = sum(len(words[i]) + 1 for i in part if "𓀀" not in words[i])
        assert lengths == pytest.approx(plain + sum(3 for i in part if "𓀀" in words[i]))


def test_scores_brute(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in lattice.score_texts(docs, piece_codec.read_pieces(PIECES)).collect()}
    texts = {r["doc_id"]: Counter([*(r["text"] or "").encode().lower().split(), b""]) for r in docs.collect()}
    train = Counter()
    for k, words in texts.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            train.update(words)
    total = sum(train.values())
    for k, words in texts.items():
        r = rows[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            sum(words.values()), sum(n for w, n in words.items() if train[w]), total)
        base = sum(n * math.log10((train[w] + 1) / (total + len(train) + 1)) for w, n in words.items())
        assert r["base_score"] == pytest.approx(base) and r["held_out"] == (zlib.crc32(str(k).encode()) % 7 == 2)
        assert r["score"] < 0


def test_pseudonyms(spark):
    text = (
        "a@b.example.com +1 (017) 555-7713 4111 1111 1111 1111 4111111111111111 4111111111111112 10.0.0.255 999.1.1.1 "
        "1984-02-29 29/02/1984 1983-02-29 123-45-6789 000-45-6789 " + "b44e15e0" * 5 + " 12345678901234567890123"
    )
    docs = spark.createDataFrame([(1, text), (2, "again 4111-1111-1111-1111 and 29.02.1984"), (3, "v1.2.3 of 12"), (4, None)], "doc_id int, text string")
    out = {r["doc_id"]: r for r in pii.pseudonymise(docs, counts="n").collect()}
    one, two = out[1]["text"].split(" "), out[2]["text"].split(" ")
    assert out[1]["n"].asDict() == {"email": 1, "phone": 1, "card": 2, "ssn": 1, "ip": 1, "date": 2, "secret": 1}
    assert out[3]["text"] == "v1.2.3 of 12" and out[4]["text"] is None
    card = one[8]
    assert "".join(one[4:8]) == card == two[1].replace("-", "") and card != "4" + "1" * 15
    digits = [int(c) for c in card][::-1]
    assert sum(digits[0::2] + [sum(divmod(2 * d, 10)) for d in digits[1::2]]) % 10 == 0
    assert one[9] == "4111111111111112" and one[11] == "999.1.1.1" and one[14] == "1983-02-29" and one[16] == "000-45-6789"
    day = one[12].split("-")
    assert one[13] == "/".join(day[::-1]) and two[3] == ".".join(day[::-1]) and one[12] != "1984-02-29"
    assert one[18] == "12345678901234567890123" and one[15] != "123-45-6789"


def test_permutations(spark):
    """Every value of a small format has its own pseudonym."""
    two = spark.range(100).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("d"))
    assert two.select(pii.permute_digits(F.col("d"), F.lit("k")).alias("p")).distinct().count() == 100
    days = spark.range(0, 73049, 7).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    assert days.select(pii._date(F.col("d"), F.lit("k")).alias("p")).filter("p IS NOT NULL").distinct().count() == days.count()


def test_words_that_collide_under_powers_of_a_base():
    word = "a"
    while len(word) < 4096:  # Thue-Morse and its complement agree in every polynomial hash modulo 2**64
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word, other, f"x {word} {other} x"]
    encoder, library = packing.WordTokenizer(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    assert [m.tolist() for m in encoder(texts)] == [t.ids for t in library.encode_batch(texts, add_special_tokens=False)]
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    codec = piece_codec.PieceCodec(piece_codec.vocabulary(PIECES))
    assert [list(map(int, i)) for i in codec.encode(texts)] == [pieces.encode(t) for t in texts]
    words = quality.WordHasher(lower=True)(texts)
    assert len(set(words.hash.tolist())) == 3


def test_pii_long_texts_without_blanks(spark):
    texts = ["x" * 1_000_000, "1a" * 200_000, "a@" + "b." * 100_000 + "com", "a@" * 100_000, "f" * 31 + "g" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = {r.doc_id: r.text for r in pii.pseudonymise(docs).collect()}
    assert [out[i] for i in (0, 2, 3, 4)] == [texts[i] for i in (0, 2, 3, 4)] and len(out[1]) == len(texts[1])
    docs = spark.createDataFrame([(1, "bob@site.com. +49 123 4567 8901bob@x.com, a@b.co.1 @b.com a@b")], "doc_id int, text string")
    assert "bob" not in (text := pii.pseudonymise(docs).collect()[0].text) and text.count("@mail.invalid") == 3


def test_shards_do_not_depend_on_files_and_move_little(spark):
    rows = [(i, f"text {i % 7}") for i in range(4000)] + [(5, "text 5")] * 1500 + [(None, None)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (
        sorted(map(str, sharding.shard(d).drop("slot").collect())) for d in (docs.coalesce(1), docs.repartition(7)))
    assert one == two
    keys = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    before, after = ({r.doc_id: r.shard for r in sharding.shard(keys, shards=n).collect()} for n in (24, 25))
    moved = [k for k in before if before[k] != after[k]]
    assert len(moved) / 20_000 < 0.08 and sum(after[k] != 24 for k in moved) / 20_000 < 0.04


@pytest.mark.parametrize("end_id", [0, 70_000])
def test_packed_ids_are_whole(spark, end_id):
    texts = ["", None, "some words here", "word " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = packing.pack_documents(docs, WORD_BPE, end_id=end_id).collect()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    library = Tokenizer.from_file(WORD_BPE)
    for k, t in enumerate(texts):
        pieces = sorted((r.piece, bytes(r.ids)) for r in rows if r.doc_id == k)
        ids = np.frombuffer(b"".join(raw for _, raw in pieces), dtype="<u4").tolist()
        assert ids == [*library.encode(t or "", add_special_tokens=False).ids, end_id]


def test_packed_ids_need_one_python_worker(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id int, text string")
    plan = packing.pack_documents(docs, WORD_BPE)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # each such node of a task holds a worker of its own
