"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from rivulet.llm import chat_format, common, embedding_dedup, language_id, mixing, pieces, simhash, span_hashes, suffix_dedup, token_counts, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, block int, fp int"
RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdeétz") for _ in range(RNG.randint(1, 9))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def rows():
    """Documents with every odd thing in them; the columns block and fp clash with names that operators use."""
    a, b = prose(120, 1), prose(200, 2)
    texts = [
        a, b, a, None, "", "   ", "x", a[:300] + " new words here " + a[300:], b[:200] + b, "\x00\x01" * 80, "é" * 150, "中文字" * 60, a, "A b C d", "a B c D",
        "Orre " * 400, prose(5000, 3), "https://example.com/" + "q" * 300, "a\n\tb\r\n c", "<|endoftext|> x <|endoftext|>", None, "12345 6²³", "tail" + b[-150:],
    ]
    out = [(i, t, ["en", "de", None, "fr"][i % 4], [None, "s1", "s2", "s0", "s1"][i % 5], len(t or ""), 1, 2) for i, t in enumerate(texts)]
    return [*out, (5, "same id, other text", "en", "s1", 3, 1, 2), (None, a, "en", "s1", 3, 1, 2), (7, texts[7], "fr", "s2", 9, 1, 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def utf8(text):
    return (text or "").encode()


# ---- 1


def cut_slowly(docs, width=100):
    seen, out = set(), []
    for d, t in sorted(docs, key=lambda x: (-(1 << 63) if x[0] is None else x[0], utf8(x[1]))):
        t = utf8(t)
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if (w := t[i : i + width]) in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(w)
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def by_key(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("hot", [1, 4000])
def test_suffix_dedup(docs, empty, hot):
    got = suffix_dedup.cut_repeats(docs, hot=hot).collect()
    assert by_key(got) == by_key(cut_slowly([r[:2] for r in rows()]))
    assert suffix_dedup.cut_repeats(empty).collect() == []


def test_suffix_dedup_of_long_texts(spark):
    """Texts of several blocks, one of them with repeats within and across its blocks, and one that crosses a block's edge."""
    r = np.random.default_rng(8)
    long = r.integers(97, 123, 2_300_000).astype(np.uint8).tobytes().decode()
    edge = suffix_dedup.BLOCK
    texts = [(1, long + long[5000:5400] + long[edge - 150 : edge + 150]), (2, prose(50, 1) + long[edge - 60 : edge + 70] + long[-130:]), (3, long[:99]), (0, long[edge + 500 : edge + 700])]
    got = suffix_dedup.cut_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert by_key(got) == by_key(cut_slowly(texts))


def test_blocks_overlap(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 300)
    sizes = np.array([0, 99, 100, 1000, 250, 101, 700])
    ends = np.cumsum(sizes)
    seen = {}
    for parts in suffix_dedup._blocks(ends - sizes, ends, 100):
        assert (parts[:, 2] - parts[:, 1]).sum() <= 300 + 100
        for row, a, b in parts.tolist():
            for k in range(a, b - 99):
                seen[row, k] = seen.get((row, k), 0) + 1
    assert seen == {(row, k): 1 for row, n in enumerate(sizes) for k in range(n - 99)}


@pytest.mark.parametrize("clash", [False, True])
def test_runs_are_merged_as_one_array_has_them(monkeypatch, clash):
    r = np.random.default_rng(3)
    base = r.integers(0, 3, 4000).astype(np.uint8)
    spans = [base[i : i + n] for i, n in zip(r.integers(0, 3800, 120).tolist(), r.integers(100, 168, 120).tolist(), strict=True)]
    end = np.cumsum(list(map(len, spans)))
    start, data = end - list(map(len, spans)), np.concatenate(spans)
    want = suffix_dedup._later(data, start, end, 100)
    if clash:
        plain = suffix_dedup._hashes
        monkeypatch.setattr(suffix_dedup, "_hashes", lambda d, n: plain(d, n) % np.uint64(50))
    got = suffix_dedup._across(data, start, end, r.integers(0, suffix_dedup.RUNS, 120), 100)
    assert want.any() and (got == want).all()


def test_cut_text_keeps_columns(docs):
    got = suffix_dedup.cut_text(docs)
    assert got.columns == [*docs.columns, "n_cut"]
    assert got.where("text IS NULL").count() == 2


@pytest.mark.parametrize(("n", "letters"), [(1, 1), (6, 2), (300, 2), (3000, 4), (4000, 26)])
def test_suffix_array_and_prefixes(n, letters):
    x = np.random.default_rng(n).integers(0, letters, n).astype(np.uint8)
    x = np.concatenate([x, x[n // 3 :], x[: n // 2]])
    b, sa = x.tobytes(), suffix_dedup.suffix_array(x)
    assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    for k, l in enumerate(suffix_dedup.common_prefixes(x, sa, 100).tolist()):  # noqa: E741
        p, q = (b[sa[k - 1] :], b[sa[k] :]) if k else (b"", b"")
        assert l == next((i for i, (c, d) in enumerate(zip(p[:100], q[:100], strict=False)) if c != d), min(100, len(p), len(q)))


# ---- 2


def test_language_id(spark, docs, empty):
    kinds = {"en": "the and of that with from ", "de": "der und die das nicht für ", "fr": "le et la que pour être "}
    train = spark.createDataFrame([(i, k * (3 + i % 5), lang) for i, (lang, k) in enumerate(sorted(kinds.items()) * 10)], "doc_id long, text string, lang string")
    profiles = language_id.train(train)
    assert sorted(profiles) == ["de", "en", "fr"]
    got = language_id.predict(train, profiles).collect()
    assert all(sorted(kinds)[r.doc_id % 3] == r.lang_pred and 0 <= r.score <= 1 for r in got)
    odd = {(r.doc_id, r.lang_pred == "und") for r in language_id.predict(docs, profiles).collect()}
    assert {(3, True), (4, True), (9, True), (0, False), (None, False)} <= odd
    assert {r.lang_pred for r in language_id.predict(docs, {}).collect()} == {"und"}
    assert language_id.train(empty) == {} and language_id.predict(empty, profiles).collect() == []


def profile_slowly(texts, size):
    """The most frequent n-grams of texts, ties by code points, counted one by one."""
    counts = {}
    for t in texts:
        s = re.sub(" +", " ", "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in f" {t} "))
        for n in (1, 2, 3):
            for i in range(len(s) - n + 1):
                if (g := s[i : i + n]) != " ":
                    counts[g] = counts.get(g, 0) + 1
    code = lambda g: sum((1 if c == " " else ord(c)) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:size]]


def test_language_id_is_out_of_place_ranking(spark, docs):
    r = random.Random(9)
    kinds = {k: ["".join(r.choice(a) for _ in range(r.randint(1, 8))) for _ in range(60)] for k, a in (("aa", "abcdeé"), ("bb", "cdefghß"), ("cc", "ghiaxyz"))}
    rows_ = [(i, " ".join(r.choice(kinds[k]) for _ in range(r.randint(3, 300))), k) for i, k in enumerate(["aa", "bb", "cc"] * 20)]
    train = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    for size in (30, 400):
        profiles = {k: profile_slowly([t for _, t, x in rows_ if x == k], size) for k in kinds}
        texts = [(i, t) for i, t, _ in rows_] + [(1000 + i, x[1]) for i, x in enumerate(rows())]
        got = language_id.predict(spark.createDataFrame(texts, "doc_id long, text string"), language_id.train(train, size=size), size=size)
        for (_, t), x in zip(texts, sorted(got.collect(), key=lambda x: x.doc_id), strict=True):
            mine = profile_slowly([t or ""], size)
            if not any(c.isalpha() for c in t or ""):
                assert (x.lang_pred, x.score) == ("und", 0)
                continue
            far = {k: sum(abs(p.index(g) - i) if g in p else size for i, g in enumerate(mine)) for k, p in profiles.items()}
            best = min(far, key=lambda k: (far[k], k))
            assert x.lang_pred == best and x.score == pytest.approx(1 - far[best] / (size * len(mine)))


def test_grams_in_pieces(monkeypatch):
    text = "Ab, c'é  dd\n" * 40
    whole = language_id._grams(text)
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(language_id, "PIECE", size)
        g, c = language_id._grams(text)
        assert g.tolist() == whole[0].tolist() and c.tolist() == whole[1].tolist()


# ---- 3


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("cache", [3, 1000])
def test_token_counts(docs, empty, name, cache):
    import public_tokenizers

    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        t = token_counts._tokenizer(path)
        count = lambda s: len(t.encode(s, add_special_tokens=False).ids)
    else:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda s: len(sp.encode(s))
    want = [(r[0], len(utf8(r[1])), count(r[1] or ""), count(r[1] or "") > 1024) for r in rows()]
    assert by_key(token_counts.count_tokens(docs, path, cache=cache).collect()) == by_key(want)
    assert token_counts.count_tokens(empty, path).collect() == []


def test_token_counts_of_many_tasks_in_one_worker(docs, monkeypatch):
    """Memory stays as it is from task to task: a tokenizer for each had left some MB behind."""
    import ctypes
    import gc

    import public_tokenizers

    t = token_counts._tokenizer(path := public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: f)
    task, r, held = token_counts.count_tokens(docs, path), random.Random(5), []
    for _ in range(12):
        texts = [" ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 12))) for _ in range(2000)) for _ in range(5)]
        (got,) = task(iter([pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], ["doc_id", "text"])]))
        assert got.column("n_tokens").to_pylist() == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
        gc.collect()
        ctypes.CDLL(None).malloc_trim(0)
        with open("/proc/self/statm") as f:
            held.append(int(f.read().split()[1]) * 4096 / 1e6)
    assert held[-1] - held[3] < 16


def test_tokenizer_of_a_file_that_is_replaced(docs, tmp_path):
    import shutil

    import public_tokenizers

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        shutil.copy(public_tokenizers.path(name), tmp_path / "t.json")
        want = token_counts.count_tokens(docs, public_tokenizers.path(name)).collect()
        assert by_key(token_counts.count_tokens(docs, str(tmp_path / "t.json")).collect()) == by_key(want)


def test_pre_tokens_of_all_kinds():
    import public_tokenizers

    t, r = token_counts._tokenizer(public_tokenizers.path("byte_bpe_50k.json")), random.Random(3)
    chars = "ab'streDLl   x y\n\t.,1²½_\x1c\x85\xa0éßªº“”–€中　😀"
    for _ in range(3000):
        s = "".join(r.choice(chars) for _ in range(r.randint(0, 12)))
        assert sum(len(t.encode(x, add_special_tokens=False).ids) for _, x in token_counts.stretches(s)) == len(t.encode(s, add_special_tokens=False).ids)
        assert "".join(x for _, x in token_counts.stretches(s)) == s
        if not token_counts.UNSURE.search(s):
            assert token_counts.regex.findall(token_counts.PATTERN, s) == [s[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(s)]


# ---- 4


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows())
    sizes = {}
    for r in rows():
        sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    names = sorted(k for k in sizes if k is not None) + [None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    total, full, goal = sum(sizes.values()), set(), {}
    while True:  # reshare until none is above its cap
        rest = total - sum(3 * sizes[k] for k in full)
        goal = {k: 3 * sizes[k] if k in full else rest * weight[k] / sum(weight[x] for x in names if x not in full) for k in names}
        more = {k for k in names if k not in full and goal[k] > 3 * sizes[k]}
        if not more:
            break
        full |= more
    most = max(r.size for r in got)
    for k in names:
        mine = [r for r in got if r.source == k]
        assert all(abs(r.target - goal[k]) < 1e-6 * total and r.source_size == sizes[k] and r.taken <= 3 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - goal[k]) <= most
    assert by_key(map(str, r) for r in got) == by_key(map(str, r) for r in mixing.mix(docs.repartition(5)).collect())
    assert mixing.mix(empty).collect() == []


def test_splitting_tree(spark):
    quotas = [(1, 700), (2, 0), (3, 41), (4, 3)]
    got = {r["rank"]: r.dealt for r in mixing.split(spark.createDataFrame(quotas, "rank long, quota long"), 8, 1).collect()}
    assert all(sum(got[k]) == n for k, n in quotas)
    assert set(map(sum, zip(*got.values(), strict=True))) <= {93}
    draws = [{r["rank"]: r.dealt[0] for r in mixing.split(spark.createDataFrame(quotas, "rank long, quota long"), 2, s).collect()}[1] for s in range(8)]
    assert len(set(draws)) > 1 and all(abs(x - 350) < 25 for x in draws)


def test_shuffled_mix(docs):
    d = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    want = {r.doc_id: len(r.shards) for r in mixing.mix(d).collect()}
    got = mixing.shuffled(d)
    counts = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in want.items() if v} and got.columns == [*d.columns, "shard"]


# ---- 5


def test_embeddings(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((300, 16))
    near = base[:60] + 0.08 * r.standard_normal((60, 16))
    v = [x.tolist() for x in np.concatenate([base, near, base[:5], 3 * base[5:10]])]
    v += [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0] * 3, [float("inf")] + [0.0] * 15]
    data = list(enumerate(v))
    got = {x.vec_id: x for x in embedding_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    n = len(base) + len(near) + 10
    m = np.array(v[:n])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    links = (m @ m.T >= 0.95) & ~np.eye(n, dtype=bool)
    found = sum(got[i].n_links for i in range(n))
    assert 0.9 * links.sum() <= found <= links.sum() and all(got[i].n_links <= links[i].sum() for i in range(n))
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(n, len(v)))
    roots = common.local_roots(n, *np.nonzero(links))
    assert np.mean([got[i].component_id == roots[i] for i in range(n)]) > 0.9
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def all_links(v):
    m = np.array(v, np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return (m @ m.T >= 0.95) & ~np.eye(len(m), dtype=bool)


def test_embeddings_of_other_lengths_and_shared_ids(spark):
    r = np.random.default_rng(4)
    short = (np.ones((20, 8)) + 0.01 * r.standard_normal((20, 8))).tolist()
    long = [[1.0] * 9, [1.0] * 8 + [1.01]]
    data = [(i, v, "a") for i, v in enumerate(short + long)] + [(3, short[3], "b"), (3, (-np.array(short[0])).tolist(), "c"), (None, short[5], "d"), (None, None, "e")]
    d = spark.createDataFrame(data, "vec_id long, embedding array<double>, n_links string")
    got = embedding_dedup.near_duplicates(d).collect()
    want = [(i, 21, 0, not i) for i in range(20)] + [(20, 1, 20, True), (21, 1, 20, False), (3, 21, 0, False), (3, 0, 3, True), (None, 21, 0, False), (None, 0, None, True)]
    assert by_key(got) == by_key(want)


def test_embedding_recall(spark):
    """Against all pairs, of links whose cosine lies just above the limit as well."""
    r = np.random.default_rng(6)
    base = r.standard_normal((700, 64))
    v = np.concatenate([base, *(base[:150] + e * r.standard_normal((150, 64)) for e in (0.05, 0.2, 0.3, 0.32))]).astype(np.float32)
    links = all_links(v)
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {x.vec_id: x.n_links for x in embedding_dedup.near_duplicates(d).collect()}
    assert all(got[i] <= links[i].sum() for i in got)
    assert sum(got.values()) >= 0.95 * links.sum()


def test_embedding_tiles(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 7)  # every filter of the cluster is cut; the plan has the number
    r = np.random.default_rng(2)
    v = np.ones((60, 8)) + 0.05 * r.standard_normal((60, 8))
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()
    assert {(x.n_links, x.component_id) for x in got} == {(59, 0)}


# ---- 6


def test_pieces_match_the_library(docs, empty):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.load(path)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.exact) for r in pieces.round_trip(docs, path).collect()}
    want = {(r[0], len(ids), hashlib.sha256(np.array(ids, np.int32).tobytes()).hexdigest(), True) for r in rows() for ids in [sp.encode(r[1] or "")]}
    assert got == want
    table = pieces.by_word(pieces.frequent_words(docs, model))
    assert table and all(np.frombuffer(ids, np.int32).tolist() == model.encode_word(w) for w, ids in table.items())
    back = pieces.decode(pieces.encode(docs, path), path)
    assert all(r.decoded == (r.text or "") for r in back.collect())
    assert pieces.round_trip(empty, path).collect() == []


def test_viterbi_fold(spark):
    import public_tokenizers

    model = pieces.Model(public_tokenizers.path("piece_bpe_32k.model"))
    model.unigram = True
    model.normal = {p: (i, -float(len(p)) - (hash(p) % 7) / 8 + 2.0 * len(p)) for p, (i, _) in model.normal.items() if len(p) < 4}
    model.longest, model.least = 3, min(s for _, s in model.normal.values())
    words = ["▁hello", "▁thinking", "é中x", "▁", "q"]
    got = {r.word: r.ids for r in pieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), model).collect()}

    def score(ids):
        return sum(dict(model.normal.values())[i] if i in dict(model.normal.values()) else model.least - 10 for i in ids)

    for w in words:
        assert "".join(model.decode([i]) if i in model.of_byte else model.texts[i] for i in got[w] if i not in model.of_byte) in w or any(i in model.of_byte for i in got[w])
        assert score(got[w]) == pytest.approx(score(model.encode_word(w)))


# ---- 7


def test_warc(spark):
    long = "".join(chr(97 + i % 26) for i in range(3210))
    pages = [(1, "http://a/ b\n", long), (2, None, long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "é", "é" * 700), (7, "x", "é" * 700), (None, "n", "é" * 700), (8, "crlf", "\r\n\r\nWARC/1.1\r\n" * 80)]
    d = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string")
    manifest = warc.write_archives(warc.plan(d), chunk=500)
    chunks = warc.read_archives(manifest, chunk=500).collect()
    whole = {}
    for r in sorted(chunks, key=lambda r: r.chunk_no):
        if r.record_type == "response":
            whole.setdefault((r.page_id, r.payload_digest if r.last else None), []).append(bytes(r.chunk))
    assert max(len(r.chunk) for r in chunks) <= 500
    got = by_key(tuple(r) for r in warc.read_archives(manifest, payload=False).where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    keep = {long: 2, "é" * 700: 7}
    want = []
    for p, _, h in pages:
        b = utf8(h)
        k = keep.get(h)
        revisit = k is not None and p != k
        want.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", k if revisit else None))
    assert got == by_key(want)
    text = [bytes(r.chunk) for r in sorted((r for r in chunks if r.page_id == 8), key=lambda r: r.chunk_no)]
    assert b"".join(text).decode() == pages[-1][2]
    assert warc.read_archives(warc.write_archives(warc.plan(d.limit(0)))).collect() == []


# ---- 8


def print_slowly(text, n=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("tile", [2, 8192])
def test_simhash(docs, empty, tile):
    got = simhash.near_duplicates(docs, tile=tile).collect()
    prints = [(r[0], print_slowly(r[1])) for r in rows()]
    assert sorted((str(r.doc_id), r.fp % (1 << 64)) for r in got) == sorted((str(i), f) for i, f in prints)
    x, y = np.nonzero([[(a ^ b).bit_count() <= 4 for _, b in prints] for _, a in prints])
    label = common.local_roots(len(prints), x, y)
    least = {}
    for (i, _), k in zip(prints, label, strict=True):
        if i is not None:
            least[k] = min(i, least.get(k, i))
    assert sorted((str(r.doc_id), r.component_id) for r in got) == sorted((str(i), least.get(k)) for (i, _), k in zip(prints, label, strict=True))
    assert simhash.near_duplicates(empty).collect() == []


def test_similar(spark, empty):
    r, texts = random.Random(3), []
    for k in range(25):
        words = prose(300, 50 + k).split()
        texts.append(" ".join(words))
        for edits in (1, 3, 6, 30, 60):
            w = list(words)
            for _ in range(edits):
                w[r.randrange(len(w))] = f"new{r.random()}"
            texts.append(" ".join(w))
    texts += [texts[0], None, "", " ", "a b", "A  b", "a c"]
    grams = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    x, y = np.nonzero([[len(a & b) >= 0.8 * len(a | b) for b in grams] for a in grams])
    want = common.local_roots(len(texts), x, y)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for tile in (20, 8192):
        got = {q.doc_id: q.component_id for q in simhash.similar(d, tile=tile).collect()}
        assert np.mean([got[i] == want[i] for i in range(len(texts))]) > 0.97
        assert all(want[i] == want[got[i]] for i in got)  # nothing unlike is joined
    assert simhash.similar(empty).collect() == []


def near_limit(members, edits):
    """Variants of one text, many pairs of which are just above or below 0.8 alike, and their exact components."""
    r, base, texts = random.Random(11), prose(304, 77).split(), []
    for _ in range(members):
        w = list(base)
        for k in r.sample(range(0, 300, 5), r.randint(*edits)):
            w[k] = f"new{r.random()}"
        texts.append(" ".join(w))
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    x, y = np.nonzero([[len(a & b) >= 0.8 * len(a | b) for b in grams] for a in grams])
    return texts, common.local_roots(members, x, y).tolist()


@pytest.mark.parametrize("tile, meet", [(50, 1 << 19), (8192, 1 << 13)])
def test_similar_at_the_limit(spark, monkeypatch, tile, meet):
    monkeypatch.setattr(simhash, "MEET", meet, raising=False)
    texts, want = near_limit(200, (4, 6))
    assert 1 < len(set(want)) < 200
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {q.doc_id: q.component_id for q in simhash.similar(d, tile=tile).collect()}
    assert [got[i] for i in range(200)] == want


def test_similar_proposes_pairs_at_the_limit():
    r, found = np.random.default_rng(2), []
    for _ in range(400):
        h = r.integers(0, 1 << 63, 333, dtype=np.uint64)
        pair = [np.unique(h[:300]), np.unique(np.concatenate([h[:267], h[300:]]))]  # 267 of 333 shared: 0.802
        bits = (simhash.combined(iter(pair[:1])) ^ simhash.combined(iter(pair[1:]))).bit_count()
        p, q = (np.frombuffer(simhash.sketch(x), np.uint8) for x in pair)
        like = ((p == q) & (p > 0)).sum() / ((p > 0) | (q > 0)).sum()
        found.append(bits <= simhash.WIDE_RADIUS and like >= 0.8 - simhash.SLACK)
    assert np.mean(found) >= 0.99


def meeting(d):
    """How many pairs of rows have a key in common, counted for each such key."""
    keys = [k for (k,) in d.select("key").collect()]
    n = np.unique(keys, return_counts=True)[1]
    return (n * (n - 1) // 2).sum()


def test_similar_meets_few_pairs(spark):
    """Unlike texts hardly meet, so that the work doesn't grow with the square of their number; like ones are all proposed."""
    r = np.random.default_rng(4)
    marks, sets = [], [r.integers(0, 1 << 63, 400, dtype=np.uint64) for _ in range(3000)]
    sets += [np.concatenate([h[:380], r.integers(0, 1 << 63, 20, dtype=np.uint64)]) for h in sets[:200]]  # 0.905 alike
    for i, h in enumerate(map(np.unique, sets)):
        marks.append((i, simhash.combined(iter([h])), simhash.sketch(h)))
    d = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64)), bytearray(m)) for i, f, m in marks], "node long, fp long, sketch binary")
    assert meeting(simhash._dealt(d, simhash._slots(0.8 - simhash.SLACK), 8192)) < 0.01 * len(sets) ** 2 / 2
    assert {tuple(q) for q in simhash.proposed(d, 0.8).collect()} == {(i, 3000 + i) for i in range(200)}


@pytest.mark.parametrize("filled", [1, 2, 3, 10, 40, 63, 64])
def test_sketches_as_alike_share_a_key(filled):
    r = np.random.default_rng(filled)
    for least in (0.35, 0.5, 0.65, 0.8):
        for _ in range(50):
            p, q = np.zeros((2, simhash.SLOTS), np.uint8)
            at = r.permutation(simhash.SLOTS)[:filled]
            p[at] = q[at] = r.integers(1, 256, filled)
            other = np.sort(at)[:: max(1, round(1 / (1 - least)))] if r.random() < 0.5 else r.permutation(at)  # one in each run, or any
            for k in other[: int((1 - least) * filled + 1e-9)]:
                q[k] = (0, q[k] % 255 + 1)[int(r.integers(2))]
            like = ((p == q) & (p > 0)).sum() / ((p > 0) | (q > 0)).sum()
            rows, keys = simhash._slots(least)(pa.RecordBatch.from_pydict({"sketch": [p.tobytes(), q.tobytes()]}))
            assert like >= least - 1e-9 and set(keys[rows == 0]) & set(keys[rows == 1])


def test_simhash_meets_few_pairs(spark):
    """Unlike fingerprints hardly meet, so that the work doesn't grow with the square of their number; all near ones are linked."""
    r = np.random.default_rng(6)
    fps = r.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    near = fps[:300].copy()
    for i in range(300):
        near[i] ^= np.bitwise_or.reduce(np.uint64(1) << r.permutation(64)[: 1 + i % 5].astype(np.uint64))  # 1 to 5 bits differ
    both = np.concatenate([fps, near]).view(np.int64)
    d = spark.createDataFrame([(f,) for f in both.tolist()], "fp long")
    assert meeting(simhash._dealt(d.select(F.col("fp").alias("node"), "fp"), simhash._blocks(4), 8192)) < 0.01 * len(both) ** 2 / 2
    want = {tuple(sorted((int(both[i]), int(both[20_000 + i])))) for i in range(300) if i % 5 < 4}
    assert {tuple(q) for q in simhash.links(d).collect()} == want


def test_similar_with_repeats(spark):
    texts = []
    for k in range(8):
        line = f"{prose(12, 400 + k)} "
        texts += [f"{prose(150, 500 + k)} {line * n}{prose(150, 600 + k)}" for n in (2, 60)]  # the same set of shingles
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {q.doc_id: q.component_id for q in simhash.similar(d).collect()} == {i: i - i % 2 for i in range(16)}


def test_similar_compares_each_different_text(spark):
    def marks(words):
        h = np.unique(np.concatenate(list(simhash.shingles(" ".join(words).encode(), 5))))
        return simhash.combined(iter([h])), simhash.sketch(h)

    y = [f"w{i}" for i in range(904)]  # 900 shingles
    z = [f"new{i}" if i % 10 == 5 and i < 200 else w for i, w in enumerate(y)]  # 800 of 1000 shared with y, 799 with x
    x = next(x for k in range(10_000) if marks(x := [*y[:-1], f"end{k}"]) == marks(y))
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((x, y, z))], "doc_id long, text string")
    assert {q.doc_id: q.component_id for q in simhash.similar(d).collect()} == {0: 0, 1: 0, 2: 0}


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    got = {x.node: x.root for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    a, b = np.array(edges).T
    want = common.local_roots(1200, a, b)
    assert got == {int(i): int(want[i]) for i in {x for e in edges if e[0] != e[1] for x in e}}


# ---- 9


def test_chat_round_trip(spark):
    odd = ["</turn></end>\n### user\n", "\\b\\l<#\\", "", None, "é\n", "### assistant\nhi</end>"]
    chats = [(c, t, role, odd[(c + t) % 6], "x") for c in range(9) for t, role in enumerate(["system", "user", "assistant", "assistant", "user", None, "a\nb#<\\"][: c + 1])]
    chats += [(None, 1, "user", "hi", "x"), (3, None, "assistant", "first", "x"), (3, 2, "user", "tie", "x"), (3, 2, "user", "tie", "x")]
    d = spark.createDataFrame(chats, "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat_format.format_chats(d)
    got = {r.conv_id: r for r in chat_format.loss(chat_format.parse_chats(formatted)).collect()}
    for c in {x[0] for x in chats}:
        mine = sorted((x for x in chats if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(t.role, t.text) for t in got[c].turns] == [(x[2] or "", x[3] or "") for x in mine]
        assert got[c].loss == "".join(x[3] or "" for x in mine if x[2] == "assistant")
        heads = sum(i == 0 or (mine[i - 1][2] or "") != (x[2] or "") for i, x in enumerate(mine))
        assert got[c].formatted.count("### ") == heads
    assert chat_format.format_chats(d.limit(0)).collect() == []


def test_mask_covers_the_loss(spark):
    chats = [(c, t, role, f"{role}<{t}>#\\ é") for c in range(6) for t, role in enumerate((["user", "assistant", "assistant", "tool"] * 9)[: 3 + 5 * c])]
    d = chat_format.loss(chat_format.parse_chats(chat_format.format_chats(spark.createDataFrame(chats, "conv_id long, turn long, role string, text string"))))
    for r in d.collect():
        back = [r.formatted[m.start - 1 : m.start - 1 + m.length].replace("\\l", "<").replace("\\h", "#").replace("\\b", "\\") for m in r.mask]
        assert back == [x[3] for x in chats if x[0] == r.conv_id and x[2] == "assistant"] and "".join(back) == r.loss


def test_a_long_conversation_takes_time_by_its_length(spark):
    def seconds(n):
        d = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text <"), "id").alias("text"))
        began = time.perf_counter()
        (r,) = chat_format.digest(chat_format.parse_chats(chat_format.format_chats(d))).collect()
        assert r.n_turns == n and r.loss_chars == sum(6 + len(str(k)) for k in range(1, n, 2))
        return time.perf_counter() - began

    seconds(1000)
    short, long = min(seconds(8000) for _ in range(2)), min(seconds(16000) for _ in range(2))
    assert long < 2.5 * short + 0.5


# ---- 10


def test_span_hashes():
    r = random.Random(2)
    for _ in range(200):
        s = "".join(r.choice("ab") for _ in range(r.randint(0, 40)))
        t = s[: r.randint(0, len(s))] + "".join(r.choice("ab") for _ in range(r.randint(0, 9)))
        p, q = (span_hashes.Prefix(span_hashes._codes(x)) for x in (s, t))
        i, j = r.randint(0, len(s)), r.randint(0, len(t))
        n = next((k for k, (x, y) in enumerate(zip(s[i:], t[j:], strict=False)) if x != y), min(len(s) - i, len(t) - j))
        assert span_hashes.common_extension(p, i, q, j) == n
        assert span_hashes.equal(p, i, q, j, n)


def print_of(text, span=8, size=64):
    """Fingerprint and sketch of a text, span by span, in plain integers."""
    p, mask = (1 << 31) - 1, (1 << 64) - 1

    def of(t):
        return [sum((ord(c) + 1) * pow(b, i, p) for i, c in enumerate(t)) % p for b in span_hashes.BASES]

    hashes = set()
    for i in range(max(1, len(text) - span + 1)):
        a, b = of(text[i : i + span])
        x = a << 31 | b
        x = (x ^ x >> 31) * 0x9E3779B97F4A7C15 & mask
        hashes.add((x ^ x >> 29) >> 32)
    least = sorted(hashes)[:size]
    return f"{len(text):x}." + "".join(f"{x:08x}" for x in of(text)) + "." + "".join(f"{x:08x}" for x in least), least


def alike(a, b, size=64):
    a, b = print_of(a)[1], print_of(b)[1]
    both = sorted(set(a) | set(b))[:size]
    return sum(x in a and x in b for x in both) / len(both)


def test_prefixes_in_pieces(monkeypatch):
    codes = span_hashes._codes(prose(300, 12))
    whole = span_hashes.Prefix(codes)
    spans = np.concatenate(list(whole.spans(8)))
    monkeypatch.setattr(span_hashes, "PIECE", 64)
    span_hashes._powers.cache_clear()
    try:
        parts = span_hashes.Prefix(codes)
        assert all((a == b).all() for a, b in zip(whole.sums, parts.sums, strict=True))
        assert (np.concatenate(list(parts.spans(8))) == spans).all() and (np.concatenate(list(parts.spans(8, 5, 200))) == spans[5:200]).all()
        assert parts.span(70, 300) == whole.span(70, 300)
    finally:
        span_hashes._powers.cache_clear()


@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_fingerprints(docs, empty, ranges):
    d = docs.where("doc_id IS NULL OR n_chars != 9").where("text IS NULL OR text != 'same id, other text'")
    got = {r.doc_id: r for r in span_hashes.fingerprints(d, ranges=ranges).collect()}
    data = sorted(((r[0], r[1] or "") for r in rows() if r[4] != 9 and r[1] != "same id, other text"), key=lambda x: (x[0] is not None, x[0] or 0))
    data = [x for x in data if x[0] in got]
    assert len(got) == len(data)
    of_text = {}
    for k, (i, t) in enumerate(data):
        q, after = len(t) // 4, data[(k + 1) % len(data)][1]
        edited = t[: len(t) - q] + after[:q]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (print_of(t)[0], print_of(edited)[0])
        assert r.near_edited == alike(t, edited) and r.near_next == alike(t, after) and (edited != t or r.near_edited == 1)
        assert r.common_prefix == next((n for n, (x, y) in enumerate(zip(t, edited, strict=False)) if x != y), min(len(t), len(edited)))
        assert of_text.setdefault(t, r.fingerprint) == r.fingerprint
    assert len(set(of_text.values())) == len(of_text)
    assert span_hashes.fingerprints(empty).collect() == []


def test_repeated_ids_are_rows_of_their_own(docs):
    assert span_hashes.fingerprints(docs).count() == len(rows())


# ---- long texts


def test_long_texts(spark):
    """A text beyond every bound of what is worked on at once, and its near copy."""
    import public_tokenizers
    import sentencepiece

    long = prose(480_000, 31)
    words = long.split(" ")
    near = " ".join(["new", *words[1:240_000], "é中", *words[240_001:]])
    texts = [(0, long), (1, near), (2, "short")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    assert len(long) > max(pieces.BATCH, span_hashes.PIECE, language_id.PIECE, suffix_dedup.BLOCK) and len(words) > simhash.PIECE
    assert {r.doc_id: r.fp % (1 << 64) for r in simhash.near_duplicates(d).collect()} == {i: print_slowly(t) for i, t in texts}
    assert {r.doc_id: r.component_id for r in simhash.similar(d).collect()} == {0: 0, 1: 0, 2: 2}
    t = token_counts._tokenizer(path := public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(d, path).collect()} == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in texts}
    sp = sentencepiece.SentencePieceProcessor(model_file=(path := public_tokenizers.path("piece_bpe_32k.model")))
    got = {r.doc_id: r for r in pieces.round_trip(d, path).collect()}
    assert all(got[i].exact and got[i].ids_sha256 == hashlib.sha256(np.array(sp.encode(x), np.int32).tobytes()).hexdigest() for i, x in texts)
    prints = {r.doc_id: r for r in span_hashes.fingerprints(d).collect()}
    assert prints[0].n_chars == len(long) and prints[0].near_next > 0.9 and prints[0].common_prefix >= len(long) - len(long) // 4
    assert prints[2].edited_sha256 == hashlib.sha256(("shor" + long[0]).encode()).hexdigest()
    profiles = language_id.train(spark.createDataFrame([(9, long, "xx"), (8, "qqq www", "yy")], "doc_id long, text string, lang string"))
    assert {r.doc_id: r.lang_pred for r in language_id.predict(d.where("doc_id < 2"), profiles).collect()} == {0: "xx", 1: "xx"}
    assert mixing.mix(d.withColumn("source", F.lit("s"))).where("doc_id = 0").first().size == len(words)
