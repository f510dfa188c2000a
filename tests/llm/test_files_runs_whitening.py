"""Token files, periodic runs and whitening against brute force."""

import random
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest
from quirelake.llm import periodic_runs, queries, token_files, whitening
from quirelake.llm.common import read


def _docs(spark, rows):
    schema = "text string, doc_id long, n_words string, runs int, label string"
    return spark.createDataFrame([(t, i, "x", 1, None) for i, t in rows], schema)


# Token files ----------------------------------------------------------------------------


def _tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def _expected(rows):
    """doc_id, start, n_tokens, crc32 of rows in order."""
    t, start, out = _tokenizer(), 0, []
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_equal_the_library(spark, small):
    rows = sorted((r.doc_id, r.text) for r in read(spark, small, "documents").collect())
    found = queries.op11_token_files(spark, small).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found] == _expected(rows)


ODD = ["", None, " \t\n ", "a<|endoftext|>b <|startoftext|>", "x\x1cy\x0bz\x0cw", "Ünïcodé  ΑΣ Σ 東京   taiĺ", "́ lone mark", "don't WE'LL it's", "1234 5.6", "a" * 5000, "-- " * 400]


@pytest.mark.parametrize("bits", [False, True])
def test_odd_texts_ties_and_blocks(spark, bits):
    rows = [(i // 2 - 1 if i else None, t) for i, t in enumerate(ODD)] + [(7, "same row")] * 3
    folder = token_files.new_folder(spark)
    token_files.write_ids(_docs(spark, rows), folder, queries.tokenizer_path(), bits=bits, block=64)
    found = token_files.read_ids(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, *sorted(i for i, _ in rows if i is not None)]
    assert [r.start for r in found] == np.cumsum([0, *[r.n_tokens for r in found]])[:-1].tolist()
    t = _tokenizer()
    key = lambda i, ids: (i is not None, i or 0, ids)
    assert sorted(key(r.doc_id, list(r.ids)) for r in found) == sorted(key(i, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for i, x in rows)
    total = token_files.manifest(spark, folder).selectExpr("sum(n_ids)", "sum(n_documents)").first()
    assert tuple(total) == (sum(r.n_tokens for r in found), len(rows))


def test_no_documents(spark):
    folder = token_files.new_folder(spark)
    token_files.write_ids(_docs(spark, []), folder, queries.tokenizer_path())
    assert token_files.id_checksums(spark, folder).count() == 0


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("top", [1, 255, 256, 49_407, 70_000, 2**32])
def test_planes_round_trip(bits, top):
    rng = np.random.default_rng(top)
    for n in (1, 7, 8, 1000):
        ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
        assert (token_files.from_planes(token_files.to_planes(ids, bits), n, bits) == ids).all()


def test_a_block_is_read_by_the_index():
    writer = token_files.FileWriter(False, 100)
    import pyarrow as pa

    ids = np.arange(1050, dtype=np.uint32)
    records = [*writer.add(pa.array([1, 2]), ids, np.array([1000, 50])), *writer.close()]
    reader = token_files.FileReader(b"".join(r + b"\n" for r in records))
    assert len(reader.index) == 11 and (reader.ids(333, 777) == ids[333:777]).all() and (reader.ids_of_block(10) == ids[1000:]).all()
    with pytest.raises(ValueError, match="whole"):
        token_files.FileReader(b"".join(r + b"\n" for r in records)[:-5])


def test_vocabularies_with_spaces_in_pieces_are_rejected():
    import public_tokenizers

    with pytest.raises(ValueError, match="span"):
        token_files.WordEncoder(open(public_tokenizers.path("byte_bpe_50k.json")).read())


# Periodic runs --------------------------------------------------------------------------


def brute_runs(words):
    """Every stretch with a period, by definition."""
    n, found = len(words), []
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            start, end = i, j + p
            stretch = words[start:end]
            smallest = next(q for q in range(1, p + 1) if all(stretch[k] == stretch[k + q] for k in range(len(stretch) - q)))
            if smallest == p and end - start >= max(24, 3 * p):
                found.append((start, end - start, p))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def _texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        letters = rng.choice(["a", "ab", "abc", "abcdefgh", [f"w{k}" for k in range(500)]])
        words = []
        for _ in range(rng.randrange(1, 7)):
            unit = [rng.choice(letters) for _ in range(rng.randrange(1, 40))]
            words += (unit * rng.randrange(1, 12))[: rng.randrange(1, 150)]
        yield words


def test_runs_equal_brute_force():
    seen = 0
    for words in _texts(1, 400):
        codes = np.unique(words, return_inverse=True)[1]
        expected = brute_runs(words)
        seen += len(expected)
        assert periodic_runs.runs_of(codes) == expected
    assert seen > 300


def test_lag_counts_equal_brute_force():
    for words in [*_texts(2, 40), ["a"] * 300 + ["b", "c"] * 200 + [f"x{k}" for k in range(50)]]:
        codes = np.unique(words, return_inverse=True)[1]
        most = len(codes) // 3
        expected = [sum(codes[i] == codes[i + p] for i in range(len(codes) - p)) for p in range(most + 1)]
        assert periodic_runs.lag_counts(codes, most).tolist() == expected


def test_long_adversarial_texts_end_soon():
    one = np.zeros(200_000, np.int64)
    assert periodic_runs.runs_of(one) == [(0, 200_000, 1)]
    nearly = np.zeros(30_000, np.int64)
    nearly[::101] = 1
    assert periodic_runs.runs_of(nearly)[-1][2] in (1, 101) and (0, 30_000, 101) in periodic_runs.runs_of(nearly)


def brute_row(doc_id, text):
    words = [w for w in "".join(" " if c in "\x20\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    hexed = lambda x: sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], hexed("".join(f"{s},{n},{q}\n" for s, n, q in runs)), hexed(kept), n)


def test_op12_on_texts(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, " ".join(w)) for i, w in zip(ids, _texts(3, len(ids)), strict=False)]
    rows += [(1000 + k, " \n".join(w)) for k, w in enumerate(_texts(4, 40))]
    rows += [(5, None), (6, ""), (7, " \t\n"), (None, "a b " * 30), (8, "  \x1c " * 30), (9, "é É " * 12), (9, "é É " * 12)]
    found = periodic_runs.run_digests(periodic_runs.periodic_runs(_docs(spark, rows), tail=queries.repeated_tail)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted((brute_row(i, t) for i, t in rows), key=repr)


def test_op12_on_the_small_table(spark, small):
    rows = [r for r in read(spark, small, "documents").collect() if len((r.text or "").split()) <= 1500]
    expected = {r.doc_id: brute_row(r.doc_id, r.text) for r in rows}
    found = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, small).collect()}
    assert len(found) >= 200 and all(found[i] == e for i, e in expected.items())
    assert any(e[1] for e in expected.values())


def test_op12_of_nothing(spark):
    assert periodic_runs.run_digests(periodic_runs.periodic_runs(_docs(spark, []))).collect() == []


# Whitening ------------------------------------------------------------------------------


def _check(rows, found):
    good = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in good]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums, strict=True)] for v in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    variance = sum(Fraction((n * a - s) ** 2, n**3) for v in fit for a, s in zip(v, sums, strict=True))
    k = min(4, int((values > values[0] * 1e-12).sum()))
    assert len(found) == k * len(x)
    by = {}
    for r in found:
        by.setdefault(r.component, []).append(r)
    for c in range(1, k + 1):
        mine = sorted(by[c], key=lambda r: (r.vec_id is not None, r.vec_id or 0, r.deviation))
        theirs = sorted(((i, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)), v) for i, v in x), key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
        assert [(r.vec_id, r.deviation, r.n) for r in mine] == [(i, d, n) for i, d, _ in theirs]
        w = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums, strict=True)] for _, _, v in theirs]) @ axes[:, c - 1] / np.sqrt(values[c - 1])
        got = np.array([r.whitened for r in mine])
        assert np.allclose(got, w, rtol=1e-8, atol=1e-9) or np.allclose(got, -w, rtol=1e-8, atol=1e-9)
        assert abs(mine[0].explained / float(values[c - 1] / float(variance)) - 1) < 1e-9
        assert {r.identity_error for r in mine}.pop() < 1e-9


def test_op13_on_the_small_table(spark, small):
    rows = [(r.vec_id, r.embedding) for r in read(spark, small, "embeddings").collect()]
    _check(rows, queries.op13_whitening(spark, small).collect())


def _vectors(spark, rows):
    return spark.createDataFrame([(9, v, i, "n") for i, v in rows], "x int, embedding array<double>, vec_id long, n string")


def test_odd_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(1000 * d, 1 + d) for d in range(5)]) for i in range(60)]
    rows += [(1, rows[0][1])] * 30 + [(None, rows[1][1]), (70, None), (71, [1.0, None, 2.0, 3.0, 4.0]), (72, [float("nan")] * 5), (73, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (74, [])]
    _check(rows, whitening.whitened(_vectors(spark, rows)).collect())
    other = whitening.whitened(_vectors(spark, [*rows, (75, [1.0, 2.0])]))
    assert other.where("vec_id = 75").count() == 0


def test_few_components_and_none(spark):
    flat = [(i, [float(i), 2.0 * i, -0.0]) for i in range(9)]
    _check(flat, whitening.whitened(_vectors(spark, flat)).collect())
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, None)]):
        assert whitening.whitened(_vectors(spark, rows)).collect() == []


def test_large_entries_stay_exact(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) * 2.0**40 for _ in range(3)]) for i in range(20)]
    found = whitening.whitened(_vectors(spark, rows)).collect()
    assert len(found) == 60 and all(r.deviation is None for r in found if r.vec_id == 0)
    assert max(r.identity_error for r in found) < 1e-9
