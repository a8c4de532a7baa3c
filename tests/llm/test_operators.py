import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docketry.llm import licenses, maxscore, media, mixing, packing, repeats, secrets, simhash, token_files, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, h int, _key int"


def frame(spark, rows):
    full = [(i, t, "en", s, None if t is None else len(t), 1, "x", 2, 3) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def messy():
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma,", "dé", "漢字", "don't", "x\ty", "end."]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 40, 400, 9000)]
    rows = [(i, rng.choice(base) + (" more" if rng.random() < 0.3 else ""), rng.choice(["a", "b", None, "é"])) for i in range(40)]
    rows += [(60, " ".join(rng.choice(words) for _ in range(60_000)), "a")]
    rows += [(None, base[1], "a"), (None, None, None), (7, base[0], "b"), (7, base[0], "b"), (50, "", "a"), (51, None, "c"), (52, " \n ", "c"), (53, "<|endoftext|> a  b\n\n c ", "c")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, messy()).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_targets(sizes):
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    target, left, free = {}, float(sum(sizes.values())), set(sizes)
    while True:
        level = left / sum(weights[s] for s in free) if free else 0
        over = {s for s in free if level * weights[s] > 3 * sizes[s]}
        if not over:
            return target | {s: level * weights[s] for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over


def test_mixing(spark, docs, none):
    rows = messy()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = mixing.mix(docs, keep=["source"]).collect()
    assert len(got) == len(rows)
    want, taken = brute_targets(dict(sizes)), Counter()
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix(docs.repartition(5), keep=["source"]).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(none).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_secrets(spark, none):
    rng = random.Random(1)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(40)]
    rows = [(i, f'x token = "{h}" y', "a") for i, h in enumerate(hexes)]
    rows += [(90, "PassWord: short api-key=nothing AKIA" + "A" * 11 + " AKIA" + "B" * 12, "a"), (91, "token: secret : abcdefgh", "a"), (92, None, "a"), (93, "apikey:'abc.DEF-12' ſecret=abcdefghi", "a")]
    got = {r.doc_id: r for r in secrets.scan(frame(spark, rows)).collect()}
    first = got[0]
    assert (first.n_assign, first.n_hex, first.n_access) == (1, 1, 0) and first.spans == "assign:2:51,hex:11:51"
    assert first.base_sha256 == hashlib.sha256(b"assign:2:51,hex:11:51").hexdigest()
    at = rows[40][1].index(" AKIA" + "B" * 12) + 1
    assert (got[90].spans, got[90].n_access, got[90].n_assign) == (f"access:{at}:{at + 16}", 1, 0)
    assert got[91].spans == "" and got[92].spans == "" and got[92].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[93].n_assign == 1
    assert secrets.scan(none).count() == 0
    clean = secrets.without_secrets(frame(spark, rows))
    assert {r.doc_id: r.text for r in clean.collect()}[0] == 'x [SECRET]" y' and clean.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")


def test_format_automaton_knows_its_kind():
    rng = random.Random(2)
    values = ["sk" + "".join(rng.choice("0123456789") for _ in range(20)) for _ in range(60)]
    automata = secrets.infer({"assign": values})
    states = [automata[0].automaton.states[i] for i in automata[0].automaton.kept]
    assert len(states) == 23 and [c for c, _ in states[0].letters.most_common()] == ["s"] and states[-1].steps.keys() == {""}
    new = "sk" + "".join(rng.choice("0123456789") for _ in range(20))
    assert secrets.format_spans(f"see {new} here", [], automata) == [(4, 3, 26, new)]
    assert secrets.format_spans("see 2024-01-01-and-other-9words here", [], automata) == []


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(300 + i, rows[4][1]) for i in range(9)]  # ties
    rows += [(400, None), (450, [1.0, None] * 4), (500, [float("nan")] * 8), (None, [1.0] * 8), (550, [1e6] * 8), (550, [1e6] * 8), (600, []), (1, [5.0] * 8), (50, [9.0] * 8), (50, [9.0] * 8), (650, [1e15] * 8), (650, [-2e15] * 8)]
    spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<double>, label int").write.mode("overwrite").parquet("/tmp/checkpoints/test-top-k/embeddings.parquet")
    got = Counter(tuple(r) for r in maxscore.op3_maxscore(spark, "/tmp/checkpoints/test-top-k").collect())
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = Counter()
    for n, (q, a) in enumerate(ok):
        if q % 50 == 0:
            scores = [(-sum(x * y for x, y in zip(a, b, strict=False)), i) for m, (i, b) in enumerate(ok) if m != n]
            want.update((q, rank, i, min(max(-s, -(2**63)), 2**63 - 1)) for rank, (s, i) in enumerate(sorted(scores)[:5], 1))
    assert got == want
    empty = spark.createDataFrame([], "id long, v array<long>")
    assert maxscore.top_k(empty, empty).count() == 0


def test_top_k_keeps_vectors_and_queries_off_the_driver(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 64)  # the driver once took a copy of all queries for every shard
    rng = np.random.default_rng(6)
    v = rng.integers(-300, 300, (4000, 16))
    v[1000:1040] = v[7]  # ties, in several shards
    rows = [(int(n) // 2, n, v[n].tolist()) for n in range(4000)]
    vectors = spark.createDataFrame(rows, "id long, row long, v array<long>").repartition(3)
    want = Counter()
    for i, n, x in rows[::8]:
        scores = v @ v[n]
        want.update((i, rank, m // 2, int(scores[m])) for rank, m in enumerate(sorted((m for m in range(4000) if m != n), key=lambda m: (-scores[m], m // 2))[:5], 1))
    conf = spark.sparkContext._jsc.sc().conf()
    for blocks in (4096, 60):
        monkeypatch.setattr(maxscore, "BLOCK_QUERIES", blocks)
        conf.set("spark.driver.maxResultSize", "1m")
        try:
            found = maxscore.top_k(vectors.filter("row % 8 = 0"), vectors)
            got = Counter(tuple(r) for r in found.collect())
        finally:
            conf.remove("spark.driver.maxResultSize")
        assert got == want


@pytest.mark.parametrize("block", [7, 1024])
def test_maxscore_prunes_and_loses_nothing(block, monkeypatch):
    monkeypatch.setattr(maxscore, "POSTING_BLOCK", block)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24))
    v = np.floor(256 * (centres[rng.integers(0, 12, 3000)] + 0.2 * rng.normal(size=(3000, 24)))).astype(np.int64)
    v[100:140] = v[7]  # ties
    ids, rows = rng.permutation(3000) // 2, np.arange(3000)
    shard = maxscore.Postings(ids, rows, v)
    for i in range(0, 3000, 150):
        best = maxscore.maxscore(v[i].astype(float), i, shard, 5)
        scores = v @ v[i]
        want = sorted((-scores[j], ids[j]) for j in range(3000) if j != i)[:5]
        assert [(-s, n) for s, n in zip(best.scores, best.ids, strict=True)] == [(float(a), b) for a, b in want]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_equal_the_library(name):
    rng = random.Random(4)
    parts = ["a", "É", "é", "é", "Σ", "İ", "ß", "'s", "'", "\n", " ", "  ", "\t", "\xa0", ".", "!", "9", "12", "x\x1cy", "<|endoftext|>", "漢", "the", "Don't", "\n\n", "#", "👍", "ſ", "\x85", "-", "|", "w" * 60]
    own, library = tokens.encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_files(spark, docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    files = token_files.write_token_files(docs, path)
    got = token_files.read_token_files(files).collect()
    def ids(t):
        return np.array([*(library.encode(t, add_special_tokens=False).ids if t else []), 2], "<u4")
    want = Counter((i, len(ids(t)), zlib.crc32(ids(t).tobytes())) for i, t, _ in messy())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    known = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert known == sorted(known, key=lambda x: (x is not None, x or 0))
    assert token_files.read_token_files(token_files.write_token_files(none, path)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_token_image_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 200, n).astype("<u4")
    ids[rng.random(n) < 0.05] = rng.integers(0, 2**32, dtype=np.uint64, size=1)[0]
    image = token_files.encode_image(ids, np.array([n], np.uint32))
    back, lengths = token_files.decode_image(image)
    assert back.tolist() == ids.tolist() and lengths.tolist() == [n]
    assert token_files.read_range(image, n // 3, n // 2).tolist() == ids[n // 3 : n // 2].tolist()
    named = token_files.encode_image(ids, np.array([n, 0], np.uint32), [None, -7], 3, 2**40)
    assert token_files.documents_of(named) == ([None, -7], 3, 2**40) and token_files.decode_image(named)[0].tolist() == ids.tolist()
    for cut in (0, 3, 20, len(named) // 2):
        if cut < len(named) - (0 if n else 1):
            with pytest.raises(ValueError):
                token_files.decode_image(named[:cut])


def test_vocabulary_files_under_other_names(tmp_path):
    for name, kind in (("word_bpe_49k.json", tokens.WordPieces), ("byte_bpe_50k.json", tokens.BytePieces)):
        copy = tmp_path / f"copy_of_{name}"
        copy.write_bytes(open(public_tokenizers.path(name), "rb").read())
        own = tokens.encoder(str(copy))
        assert type(own) is kind
        assert np.frombuffer(own.ids("Some text, é."), "<u4").tolist() == Tokenizer.from_file(str(copy)).encode("Some text, é.", add_special_tokens=False).ids


def test_toxicity_learns_held_out_rows(spark, none):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 6 == 0
        text = [rng.choice(words) for _ in range(60)] + ([rng.choice(["vile", "awful", "nasty"])] if toxic else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text), "a"))
        if i % 10:
            labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (3, 1, None), (99999, 1, 1), (7, 1, int(7 % 6 == 0))]
    rows += [(None, "vile awful", "a"), (2000, None, "a"), (2001, "", "a"), (2002, "vile awful", "a"), (2002, "w1 w2", "a"), (2002, "w1 w2", "a")]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored = {r.doc_id: r.score for r in toxicity.score_documents(frame(spark, rows), marks).collect()}
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(scored[i] >= 0.5) == (i % 6 == 0) for i in held]) > 0.97
    assert scored[2000] == scored[2001] < 0.5 <= scored[None]
    thrice = sorted(r.score >= 0.5 for r in toxicity.score_documents(frame(spark, rows), marks).filter("doc_id = 2002").collect())
    assert thrice == [False, False, True] and toxicity.without_toxic(frame(spark, rows), marks).filter("doc_id = 2002").count() == 2
    assert toxicity.without_toxic(frame(spark, rows), marks).columns == frame(spark, rows).columns
    assert toxicity.score_documents(none, marks).count() == 0
    assert toxicity.score_documents(frame(spark, rows[:3]), marks.limit(0)).count() == 3


def test_toxicity_risk_and_scores_by_a_second_computation(spark):
    """The fitted weights are a minimum of the non-negative risk, written out; scores are the words' weights."""
    rng = np.random.default_rng(7)
    n, width, prior = 400, 6, 0.2
    toxic = rng.random(n) < prior
    x = (rng.random((n, width)) < np.where(toxic[:, None], [0.8, 0.3, 0.5, 0.5, 0.2, 0.1], [0.05, 0.3, 0.5, 0.4, 0.2, 0.1])).astype(float)
    rows = np.r_[x[toxic], x]
    n_pos = int(toxic.sum())
    sparse = toxicity._Rows(np.nonzero(rows)[1], rows.sum(axis=1).astype(int), np.arange(width))

    def risk(w, b):
        out = rows @ w + b
        pos, unl = out[:n_pos], out[n_pos:]
        return prior * np.mean(np.log1p(np.exp(-pos))) + max(0.0, np.mean(np.log1p(np.exp(unl))) - prior * np.mean(np.log1p(np.exp(pos)))) + 0.5 * 1e-3 * w @ w

    w, b = toxicity._descend(sparse, n_pos, prior, 3000, np.zeros(width), 1e-3)
    least = risk(w, b)
    for _ in range(300):
        step = rng.normal(size=width + 1) * rng.choice([0.3, 0.03])
        assert risk(w + step[:-1], b + step[-1]) >= least - 1e-6
    by_slot = {toxicity.slots_of("vile")[0]: 2.5, toxicity.slots_of("nasty")[1]: -0.75}
    score = toxicity.scorer(by_slot, -1.0)
    for text, total in (("Vile VILE vile", 1.5), ("nastygram, vile", 0.75), ("", -1.0), (None, -1.0), ("x " * 200_000 + "vile", 1.5)):
        assert abs(score(text) - 1 / (1 + np.exp(-total))) < 1e-12


def test_toxicity_samples_are_bounded_in_slots(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(50)) + (" vile" if i % 2 else ""), "a") for i in range(60)] + [(7, "again " * 9, "b")]
    marks = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    monkeypatch.setattr(toxicity, "MAX_POSITIVE_SLOTS", 120)
    monkeypatch.setattr(toxicity, "MAX_UNLABELLED_SLOTS", 260)
    sample = toxicity.training_rows(docs, marks)[0].mapInArrow(toxicity._slots, "positive boolean, place long, slots array<int>").cache()
    for positive, most in ((True, 120), (False, 260)):
        kept = toxicity._within(sample, positive, most).collect()
        assert 0 < len(kept) and sum(len(r.slots) for r in kept) <= most
    assert len(toxicity.train(docs, marks)) == 2


@pytest.mark.parametrize("n", [0, 1, 64, 65, 3000])
def test_media_round_trip_both_ways(n, monkeypatch):
    data, size = media.payload("é" * (n // 2) + "a" * (n % 2))
    stored = media.write_payload(data)
    image = media.decode(stored)
    assert media.read_payload(image) == data and size == n and len(data) % 64 == 0 and len(data) > 0
    monkeypatch.setattr(media, "_read_fixed", lambda *a: False)  # symbol by symbol
    assert (media.decode(stored).components[0].coefficients == image.components[0].coefficients).all()


def test_media_colour_scans():
    """A 4:2:0 file: interleaved DC with restarts, AC of each component, chroma doubled."""
    one = [1] + [0] * 15
    scan = lambda comps, tables, bits: media._segment(0xDA, bytes([len(comps), *[x for c in comps for x in (c, 0)], *tables])) + bits
    head = b"\xff\xd8" + media._segment(0xDB, bytes([0]) + bytes([8] * 64))
    head += media._segment(0xC2, bytes([8, 0, 16, 0, 16, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head += media._table(0, 0, [0, 2] + [0] * 14, [0, 3])  # 00: category 0, 01: category 3
    bits = "01" + "111" + "00" * 3 + "01" + "000" + "01" + "100"  # Y +7 0 0 0, Cb -7, Cr +4
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    image = media.decode(head + scan([1, 2, 3], (0, 0, 0), data) + b"\xff\xd9")
    assert [c.coefficients[0, 0, 0] for c in image.components] == [7, -7, 4] and (image.components[0].coefficients[:, :, 0] == 7).all()
    tensor = media.rgb(image)
    y, cb, cr = 128 + 7, 128 - 7, 128 + 4
    assert tensor.shape == (16, 16, 3) and (tensor == np.rint([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)]).astype(np.uint8)).all()


def huffman_scan(symbols):
    """Bits of (symbol, extra bits) with nine-bit codes for all 256 symbols."""
    bits = "".join((format(s, "09b") if s is not None else "") + extra for s, extra in symbols)
    bits += "1" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") if bits else b""


def magnitude(v):
    n = abs(v).bit_length()
    return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""


def end_run(run):
    n = run.bit_length() - 1
    return (n << 4, format(run - (1 << n), f"0{n}b") if n else "")


def ac_first(blocks, a, b, low):
    """Runs of zeros, signed values and runs of bands that end, of the bits above low."""
    out, ended = [], 0
    for block in blocks:
        values = [int(np.sign(v)) * (abs(int(v)) >> low) for v in block[a : b + 1]]
        last = max((i for i, v in enumerate(values) if v), default=-1)
        if last < 0:
            ended += 1
            continue
        if ended:
            out.append(end_run(ended))
            ended = 0
        zeros = 0
        for v in values[: last + 1]:
            if not v:
                zeros += 1
                continue
            out += [(0xF0, "")] * (zeros // 16)
            n, extra = magnitude(v)
            out.append((zeros % 16 << 4 | n, extra))
            zeros = 0
        ended = int(last < len(values) - 1)
        if ended:
            out.append(end_run(1))
            ended = 0
    return out + ([end_run(ended)] if ended else [])


def ac_refine(blocks, a, b, low):
    """New values of one bit, and a bit of each value that is known."""
    out = []
    for block in blocks:
        values = [int(v) for v in block[a : b + 1]]
        new = [i for i, v in enumerate(values) if abs(v) >> low == 1]
        bit = lambda v: str(abs(v) >> low & 1)
        at = 0
        for i in new:
            zeros, pending = 0, ""
            for j in range(at, i):
                if abs(values[j]) >> low > 1:
                    pending += bit(values[j])
                else:
                    zeros += 1
                    if zeros == 16:
                        out.append((0xF0, pending))
                        zeros, pending = 0, ""
            out.append((zeros << 4 | 1, ("1" if values[i] > 0 else "0") + pending))
            at = i + 1
        if at < len(values):
            out.append((0, "".join(bit(v) for v in values[at:] if abs(v) >> low > 1)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_media_general_scans_against_an_encoder(seed):
    """Two bands with runs, negative values and refinement, three components with ratio 3 to 2, by an encoder of its own."""
    rng = np.random.default_rng(seed)
    sampling = [(3, 2), (2, 1), (1, 2)]
    width, height = 70, 37
    every = [x for x in range(256)]
    head = b"\xff\xd8" + media._segment(0xDB, bytes([0]) + bytes(range(1, 65)))
    head += media._segment(0xC2, bytes([8, 0, height, 0, width, 3]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))
    head += b"".join(media._segment(0xC4, bytes([k << 4, *([0] * 8), 255, *([0] * 7)]) + bytes(every[:255])) for k in (0, 1))
    want, file = [], head
    for i, (h, v) in enumerate(sampling):
        across, down = -(-(-(-width * h // 3)) // 8), -(-(-(-height * v // 2)) // 8)
        blocks = np.where(rng.random((down * across, 64)) < rng.choice([0.03, 0.3, 0.9]), rng.integers(-40, 41, (down * across, 64)), 0)
        blocks[rng.random(len(blocks)) < 0.3, 1:] = 0
        want.append((across, down, blocks))
    scan = lambda i, a, b, high, low, data: media._segment(0xDA, bytes([1, i + 1, 0, a, b, high << 4 | low])) + data
    for i, (_, _, blocks) in enumerate(want):
        dc, before = [], 0
        for v in blocks[:, 0].tolist():
            n, extra = magnitude((v >> 1) - before)
            dc.append((n, extra))
            before = v >> 1
        file += scan(i, 0, 0, 0, 1, huffman_scan(dc)) + scan(i, 0, 0, 1, 0, huffman_scan([(None, str(v & 1)) for v in blocks[:, 0].tolist()]))
        for a, b in ((1, 20), (21, 63)):
            file += scan(i, a, b, 0, 2, huffman_scan(ac_first(blocks, a, b, 2)))
            for low in (1, 0):
                file += scan(i, a, b, low + 1, low, huffman_scan(ac_refine(blocks, a, b, low)))
    file += b"\xff\xd9"
    image = media.decode(file)
    for c, (across, down, blocks) in zip(image.components, want, strict=True):
        assert (c.coefficients[:down, :across].reshape(-1, 64) == blocks).all()
    assert media.rgb(image).shape == (height, width, 3)
    planes = [media.plane(image, c) for c in image.components]
    tensor, y, x = media.rgb(image), 36, 69
    parts = [float(p[y * v // 2, x * h // 3]) for p, (h, v) in zip(planes, sampling, strict=True)]
    assert tensor[y, x, 0] == np.clip(np.rint(np.float32(parts[0]) + np.float32(1.402) * np.float32(parts[2] - 128)), 0, 255)


def test_media_of_many_blocks_stays_within_the_format(monkeypatch):
    monkeypatch.setattr(media, "ROW_BLOCKS", 2)
    monkeypatch.setattr(media, "MOST_ROWS", 3)
    data = bytes(range(256)) * 5
    image = media.decode(media.write_payload(data))
    assert (image.width, image.height) == (56, 24) and media.read_payload(image) == data


def test_media_that_is_corrupt_says_so(spark, tmp_path):
    good = media.write_payload(media.payload("some text " * 40)[0])
    cut = [good[:n] for n in range(0, len(good) - 1, 37)]
    rng = random.Random(1)
    hurt = [bytes(b if rng.random() > 0.02 else rng.randrange(256) for b in good) for _ in range(60)]
    for file in [*cut, *hurt]:
        try:
            media.rgb(media.decode(file))
        except ValueError:
            pass
    rows = [(1, 400, good), (2, 400, good[:200]), (3, 0, b"GIF89a"), (4, None, None), (None, 1, b"")]
    df = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in media.media_features(df).collect()}
    assert got[1].error is None and got[1].payload_bytes == 448 and got[4].error == "no file"
    assert all(got[i].error and got[i].payload_sha256 is None and got[i].feature is None for i in (2, 3, 4, None))
    stored = {r.doc_id: r for r in media.rgb_tensors(df, str(tmp_path / "t")).collect()}
    assert set(stored) == {1, 2, 3, None} and stored[1].tensor and not stored[2].tensor and stored[2].error


def test_media_feature_is_that_of_the_tensor():
    data = media.payload("x é y" * 300)[0]
    image = media.decode(media.write_payload(data))
    flat = np.frombuffer(data, np.uint8).reshape(-1, 64).astype(float)
    level = np.where(flat < 128, 128 + flat, -flat)
    level[:, 0] = flat[:, 0]
    u = np.arange(8)
    cos = np.cos((2 * u[:, None] + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    zigzag = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    samples = []
    for row in level:
        block = np.zeros((8, 8))
        for (y, x), v in zip(zigzag, row, strict=True):
            block[y, x] = v
        samples.append(np.clip(np.rint(cos @ block @ cos.T + 128), 0, 255))
    flat = np.array(samples).astype(int).ravel()
    assert media.feature(media.rgb(image)) == f"8x{8 * len(level)}x3:{3 * flat.sum()}:" + "/".join(str(3 * int((flat // 64 == i).sum())) for i in range(4))


def test_media_columns(spark, docs, none):
    got = media.media_features(media.media_column(docs)).collect()
    texts = Counter((i, t or "") for i, t, _ in messy())
    assert len(got) == sum(texts.values())
    want = Counter()
    for (i, t), n in texts.items():
        raw = t.encode()
        data = raw + bytes(-len(raw) % 64 if raw else 64)
        want[i, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:])] += n
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert media.media_features(media.media_column(none)).count() == 0


def test_rgb_tensors_are_stored(spark, tmp_path):
    files = [(i, None if t is None else media.write_payload(media.payload(t)[0]), 1) for i, t in ((1, "some text"), (None, "é" * 900), (2, None), (1, ""))]
    df = spark.createDataFrame(files, "doc_id long, media binary, tensor int")
    got = media.rgb_tensors(df, str(tmp_path / "tensors")).collect()
    want = Counter((i, media.rgb(media.decode(bytes(m))).tobytes()) for i, m, _ in files if m is not None)
    assert Counter((r.doc_id, bytes(r.tensor)) for r in got) == want and all(len(r.tensor) == r.height * r.width * 3 for r in got)
    assert media.rgb_tensors(df.limit(0), str(tmp_path / "none")).count() == 0


def test_card_numbers_are_no_hex_credentials():
    rng = random.Random(12)
    formats = secrets.infer({"hex": ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(300)]})
    other = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    assert formats and secrets.format_spans(f"a {other} b", [], formats)
    for digits in (16, 40):
        assert not secrets.format_spans("card " + "".join(rng.choice("0123456789") for _ in range(digits)), [], formats)


def slow_print(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", low)
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in hashes) > len(hashes))


def slow_components(ids, prints):
    root = list(range(len(ids)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(i)
    return [min((ids[j] for j in groups[find(i)] if ids[j] is not None), default=None) for i in range(len(ids))]


def test_near_duplicates(spark, docs, none):
    rows = messy()
    prints = [slow_print(t) for _, t, _ in rows]
    want = Counter(zip([i for i, _, _ in rows], [f"{p:016x}" for p in prints], slow_components([i for i, _, _ in rows], prints), strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len({c for _, _, c in want})


@pytest.mark.parametrize("hot", [10, 200_000])
def test_trie_links_lose_nothing(spark, hot, monkeypatch):
    rng = random.Random(8)
    seeds = [rng.getrandbits(64) for _ in range(60)]
    prints = set(seeds)
    for s in seeds:
        for _ in range(8):
            s ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6)))
            prints.add(s)
    prints = sorted(prints)
    monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    from docketry.llm.components import components

    roots = {r.node: r.root for r in components(simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"))).collect()}
    want = slow_components(list(range(len(prints))), prints)
    got = [roots.get(s, s) for s in signed]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def slow_repeats(rows):
    """Of texts in order: what is removed of each."""
    seen, out = set(), []
    for text in rows:
        raw = (text or "").encode()
        cover = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                cover[s : s + 100] = b"\1" * 100
            seen.add(raw[s : s + 100])
        out.append((len(raw), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(bytes(c for c, k in zip(raw, cover, strict=True) if not k)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1, 20_000])
def test_repeats(spark, hot, monkeypatch, none):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcd é") for _ in range(400)) for _ in range(5)]
    rows = []
    for i in range(90):
        kind = rng.randrange(7)
        text = ["ab" * rng.randrange(200), "a" * rng.randrange(500), f"x{rng.randrange(3)}yz" * rng.randrange(80), "", None][kind] if kind < 5 else base[rng.randrange(5)][rng.randrange(300):] + base[rng.randrange(5)][rng.randrange(200):] + "q" * rng.randrange(130)
        rows.append((i, text))
    monkeypatch.setattr(repeats, "HOT_ENTRIES", hot)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 700)
    monkeypatch.setattr(repeats, "HOT_SHARE", 2)
    repeats._powers.clear()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(frame(spark, [(i, t, "a") for i, t in rows])).orderBy("doc_id").collect()}
    assert list(got.values()) == slow_repeats([t for _, t in rows])
    assert repeats.without_repeats(none).count() == 0


def test_repeats_of_rows_without_or_with_repeated_ids(spark, docs):
    order = docs.selectExpr("doc_id", "text").orderBy("doc_id", F.xxhash64("text"), "text").collect()  # nulls first
    want = Counter((r.doc_id, *x) for r, x in zip(order, slow_repeats([r.text for r in order]), strict=True))
    assert Counter(tuple(r) for r in repeats.without_repeats(docs).collect()) == want


def test_suffix_ranks_are_the_order_of_suffixes():
    rng = random.Random(10)
    for depth in (8, 13, 16, 100):
        text = bytes(rng.choice(b"ab") for _ in range(600)) + b"abab" * 60
        ranks = repeats.suffix_ranks(np.frombuffer(text, np.uint8), depth).tolist()
        keys = [text[i : i + depth].ljust(depth, b"\0") for i in range(len(text))]
        number = {k: i for i, k in enumerate(sorted(set(keys)))}
        assert ranks == [number[k] for k in keys]


def test_licenses(spark, none):
    texts = [t for ts in licenses.TEMPLATES.values() for t in ts]
    for t in texts:  # a text that lacks as many pairs as it may, whichever, still has a telling word
        pairs = licenses._pairs_of(t)
        told = [p for p in pairs if set(p.split(" ")) & set(licenses._telling_words())]
        assert len(pairs) - len(told) < licenses.LEAST_TEMPLATE * len(pairs)
    rows = [(i, "Some words first.\n" + t + " Then others follow here.", "a") for i, t in enumerate(texts)]
    want = {i: f for i, f in enumerate(f for f, ts in licenses.TEMPLATES.items() for _ in ts)}
    rows += [(1000 + i, t, "a") for i, t in enumerate(licenses.UNKNOWN)]
    rows += [(2000, None, "a"), (2001, "", "a"), (None, "All rights reserved.", "a"), (2002, "Her driving license was under review by the state.", "a"), (2003, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", "b")]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    right = [got[i].families == f for i, f in want.items()]
    assert np.mean(right) > 0.9, [(texts[i], got[i].families) for i in want if got[i].families != want[i]]
    assert all(got[i].n_notices == 0 for i in got if i is not None and (1000 <= i < 2003))
    assert got[None].families == "proprietary" and got[2003].families == "cc-by-nc,mit" and got[2003].n_notices == 2
    assert licenses.scan(none).count() == 0
    plan = licenses.scan(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_packing(spark, docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for weights in (None, {"a": 5, "b": 1}):
        pieces = packing.pack(docs, path, weights).collect()
        by_sequence, total = defaultdict(list), 0
        for p in pieces:
            by_sequence[p.sequence_id].append(p)
        for number, held in by_sequence.items():
            held.sort(key=lambda p: p.offset)
            assert [p.offset for p in held] == np.cumsum([0] + [p.length for p in held])[:-1].tolist()
            total = sum(p.length for p in held)
            assert total == 1024 or number == max(by_sequence)
        want = Counter()
        for i, t, _ in messy():
            want[i] += len(library.encode(t, add_special_tokens=False).ids) + 1 if t else 1
        got = Counter()
        for p in pieces:
            got[p.doc_id] += p.length
        assert got == want
        unique = [i for i, n in Counter(i for i, _, _ in messy()).items() if n == 1]
        for i, t, _ in messy():
            if i in unique:
                ids = np.array([*(library.encode(t, add_special_tokens=False).ids if t else []), 0], "<u4")
                assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids) for p in pieces if p.doc_id == i)
    assert packing.pack(none, path).count() == 0


@pytest.mark.parametrize("weights", [None, {"a": 5, "b": 1, "c": 2}, {"a": 3, "d": 0}])
def test_packing_holds_the_mixture_in_every_window(weights, monkeypatch):
    """Places of all tokens against a plain deficit loop, and the shares of every window."""
    monkeypatch.setattr(packing, "WINDOW_TOKENS", 1 << 13)
    rng = random.Random(3)
    lengths = [(s, [rng.randrange(1, 3000) for _ in range(n)]) for s, n in (("a", 90), ("b", 60), ("c", 25), (None, 3))]
    queues = packing.queues_of([(s, sum(x)) for s, x in lengths], weights)
    order, deficit, taken, turn = [], [0] * 4, [0] * 4, 0
    for phase in (0, 1):
        members = [i for i in range(4) if queues.phase[i] == phase]
        deficit = [0] * 4
        while any(taken[i] < queues.tokens[i] for i in members):
            for i in members:
                deficit[i] += int(queues.quantum[i])
                give = min((deficit[i] >> packing.FRACTION) // packing.SLICE * packing.SLICE, int(queues.tokens[i]) - taken[i])
                deficit[i] -= give << packing.FRACTION
                order += [(i, t) for t in range(taken[i], taken[i] + give)]
                taken[i] += give
    want = {x: at for at, x in enumerate(order)}
    for i, (_, x) in enumerate(lengths):
        n = np.array(x)
        ahead = np.cumsum(n) - n
        doc, token = packing.slices(ahead, n)
        at = queues.place(np.full(len(token), i), token, queues.round_of(np.full(len(token), i), token))
        assert at.tolist() == [want[i, t] for t in token.tolist()]
    window, full = packing.WINDOW_TOKENS, np.array([i for i, _ in order])
    first_empty = min(max(at for (i, _), at in want.items() if i == q) for q in range(4) if queues.phase[q] == 0)
    wanted = np.where(queues.phase == 0, queues.quantum / (1 << packing.FRACTION), 0)
    for at in range(0, first_empty - window, 97):
        assert (np.abs(np.bincount(full[at : at + window], minlength=4) - wanted) <= packing.SLICE * 6).all()


def test_ids_of_any_size_are_packed():
    for ids in ([0], [1, 255, 256], [70_000, 3], [2**32 - 1, 5]):
        assert packing.unpack_ids(packing.pack_ids(np.array(ids, "<u4").tobytes())).tolist() == ids


def test_wrapped_license_notices_are_whole(spark):
    mit = (
        "Copyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\n"
        "in the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software.\n"
    )
    gpl = (
        "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n"
        "# (at your option) any later version.\n#\n# You should have received a copy\nimport os\n"
    )
    bsd = "x = 1\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are\n * met:\n"
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\n"
    narrow = "\n".join(licenses.TEMPLATES["mit"][2].split())
    apart = "Redistribution and use in source and binary forms, with or without\n\nmodification, are permitted provided that the following conditions are met\n"
    rows = [(1, mit, "a"), (2, gpl, "a"), (3, bsd, "a"), (4, isc, "a"), (5, narrow, "a"), (6, mit + "\n" + gpl, "a"), (7, apart, "a"), (8, gpl.replace("\n", "\r\n"), "a")]
    got = {r.doc_id: (r.n_notices, r.families) for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == {1: (1, "mit"), 2: (1, "gpl-3.0"), 3: (1, "bsd"), 4: (1, "isc"), 5: (1, "mit"), 6: (2, "gpl-3.0,mit"), 7: (0, ""), 8: (1, "gpl-3.0")}


def test_formats_find_credentials_that_no_pattern_holds(spark):
    """Recall of planted credentials of several formats, none of which a fixed pattern finds."""
    rng = random.Random(21)
    hexes, upper, both = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    made = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    uuid = lambda: "-".join(made(hexes, n) for n in (8, 4, 4, 4, 12))
    words = [made("aeioulnrst", rng.randrange(2, 12)) for _ in range(800)]
    prose = lambda: " ".join(rng.choice(words) + rng.choice(["", "", ".", ","]) for _ in range(60))
    key = lambda: "gh_" + made(both, rng.randrange(30, 40))
    code = lambda: made(upper, 5) + "-" + made(upper, 5) + "-" + made(upper, 5)
    plain, rows, planted = [], [], {}
    for i in range(400):
        value = (uuid, key, code)[i % 3]()
        if i < 250:
            rows.append((i, f"{prose()} token: {value} {prose()}", "a"))
        elif i < 340:
            head = prose()
            rows.append((i, f"{head} see {value} {prose()}", "a"))
            planted[i] = f"format:{len(head) + 5}:{len(head) + 5 + len(value)}"
        else:
            plain.append(i)
            rows.append((i, f"{prose()} 4929 1234 5678 9012 on 2024-01-05 at a_long_name_of_a_thing {prose()}", "a"))
    got = {r.doc_id: r for r in secrets.scan(frame(spark, rows)).collect()}
    assert np.mean([got[i].spans == s for i, s in planted.items()]) >= 0.9
    assert all(got[i].spans == "" and got[i].best_score is None for i in plain) and all(got[i].best_score < 0 for i in planted if got[i].n_format)
    formats = secrets.learn(frame(spark, rows))
    assert len(formats) == 1 and len(formats[0].automaton.kept) > 10
    texts = {i: t for i, t, _ in rows}
    clean = {r.doc_id: r.text for r in secrets.without_secrets(frame(spark, rows)).collect()}
    for i, span in planted.items():
        if got[i].spans == span:
            _, a, b = span.split(":")
            assert clean[i] == texts[i][: int(a)] + secrets.REDACTED + texts[i][int(b):]
    assert all(clean[i] == texts[i] for i in plain)


def test_format_candidates_are_runs_and_their_parts():
    rng = random.Random(3)
    made = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    key = lambda: "sk" + made("0123456789", 20)
    formats = secrets.infer({"assign": [key() for _ in range(60)]})
    for text in ("auth={}", "bearer_key={} x", "https://host/{}", "a/{}/b?c", '"{}"', "({}).", "see {}. Then", "x:{}=", "AKIA0123456789AB={}"):
        value = key()
        whole, at = text.format(value), text.index("{")
        taken = secrets.base_spans(whole)
        assert secrets.format_spans(whole, taken, formats) == [(at, 3, at + 22, value)], text
    dotted = lambda: f"ey{made('abcdef', 6)}.{made('abcdef', 8)}.{made('0123456789', 6)}"
    formats, value = secrets.infer({"assign": [dotted() for _ in range(60)]}), dotted()
    assert secrets.format_spans(f"go {value}. And auth={value}/x", [], formats) == [(3, 3, 27, value), (38, 3, 62, value)]
    short = lambda: "q" + made("ab", 8)
    formats, value = secrets.infer({"assign": [short() for _ in range(60)]}), short()
    assert secrets.format_spans(f"go {value} on", [], formats) == [(3, 3, 12, value)]
    scores = [-0.9, -0.8, -0.85]
    assert secrets.quantile(scores, secrets.EDGE) < -0.9 and secrets.quantile(scores, 1 - secrets.EDGE) > -0.8
    assert secrets.quantile([-0.5] * 4, 0.1) == -0.5


def test_near_duplicates_keep_lone_rows_without_or_with_repeated_ids(spark):
    rng = random.Random(9)
    lone = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(9)]
    rows = [(None, t, "a") for t in lone[:4]] + [(7, lone[4], "a"), (7, lone[5], "a"), (3, lone[6], "a"), (8, lone[6], "a"), (8, lone[7], "a"), (None, lone[6], "a"), (None, lone[8], "a"), (None, lone[8], "b")]
    kept = simhash.without_near_duplicates(frame(spark, rows)).collect()
    assert Counter(r.text for r in kept) == Counter(lone)
    assert {r.text: r.doc_id for r in kept} == dict(zip(lone, [None] * 4 + [7, 7, 3, 8, None], strict=True))
    assert all((r.n_chars, r.size, r.score, r.h, r["_key"]) == (len(r.text), 1, "x", 2, 3) for r in kept)
