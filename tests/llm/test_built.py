"""Whitening, spelling variants and token files against brute force, on hard rows and small tables."""

import random
import tempfile
import zlib

import numpy as np
import pytest

from haulmark.llm.tokenfiles import Encoder, cut_at_words, id_checksums, read_metadata, read_tokens, tokenizer_text, write_tokens
from haulmark.llm.variants import near_words, spelling_variants
from haulmark.llm.whitening import by_component, deviations, square_sums, whiten
from tests.llm.helpers import frame, hard_rows

public_tokenizers = pytest.importorskip("public_tokenizers")
VECTORS = "vec_id long, embedding array<float>, label int, x string, copies int, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, "n") for i, v in rows], VECTORS)


def some_vectors(n=300, d=6, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)).astype("f4") * np.arange(1, d + 1, dtype="f4")
    return [(i, [float(c) for c in base[i]]) for i in range(n)]


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_whitening_by_brute_force(spark, weights):
    rows = some_vectors()
    rows += [(1000 + i, rows[7][1]) for i in range(200)] + [(2000, rows[8][1]), (None, rows[9][1]), (3, rows[3][1])]
    bad = [(5000, None), (5001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (5002, [float("nan")] * 6), (5003, [float("inf")] + [0.0] * 5), (5004, []), (5005, [1.0])]
    got = by_component(whiten(vectors(spark, rows + bad), ["vec_id"], components=4, weights=weights), ["vec_id"]).collect()

    x = [tuple(int(np.floor(np.float64(np.float32(c)) * 64)) + 1_000_000 for c in v) for _, v in rows]
    fit = sorted(set(x)) if weights == "one" else x
    n, sums = len(fit), [sum(v[j] for v in fit) for j in range(6)]
    z = np.array(fit, float) - np.array(sums) / n
    values, axes = np.linalg.eigh(z.T @ z / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == len(rows) * 4 and sorted({r["component"] for r in got}) == [1, 2, 3, 4]
    want = {}
    for (i, _), v in zip(rows, x, strict=True):
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        white = (np.array(v) - np.array(sums) / n) @ axes / np.sqrt(values)
        want.setdefault(i, set()).add((deviation, tuple(np.round(white[:4], 6))))
    sign = None
    by_row = {}
    for r in got:
        by_row.setdefault(r["vec_id"], {}).setdefault(r["component"], r)
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
    for i, found in by_row.items():
        deviation, white = next(iter(want[i]))
        mine = np.array([found[c]["whitened"] for c in (1, 2, 3, 4)])
        sign = np.sign(mine * white) if sign is None else sign
        assert found[1]["deviation"] == deviation and np.allclose(mine * sign, white, atol=1e-5)


def test_whitening_of_small_and_flat_tables(spark):
    assert whiten(vectors(spark, []), ["vec_id"]).count() == 0
    assert whiten(vectors(spark, [(1, None), (2, [])]), ["vec_id"]).count() == 0
    one = by_component(whiten(vectors(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0])]), ["vec_id"]), ["vec_id"]).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["explained"] is None and r["n"] == 1 and r["deviation"] == 0 for r in one)
    flat = by_component(whiten(vectors(spark, [(i, [float(i), 5.0]) for i in range(9)]), ["vec_id"]), ["vec_id"]).collect()
    assert {(r["component"], r["whitened"] is None) for r in flat} == {(1, False), (2, True)}
    assert all(r["identity_error"] < 1e-9 for r in flat)


def test_deviations_stay_exact_beyond_64_bits():
    x = np.array([[1 << 54, -(1 << 54)], [5, 7]], np.int64)
    n, sums = 10**3, [123456789012345678901, -98765432109876543210]
    exact = deviations(x, n, sums)
    assert [[int(v) for v in r] for r in exact] == [[int(a) * n - s for a, s in zip(r, sums, strict=True)] for r in x]
    small = deviations(np.array([[5, 7]], np.int64), 10**15, [6 * 10**15, 8 * 10**15])
    assert square_sums(small)[0].as_py() == 2 * 10**30
    assert square_sums(np.array([[10**25]], object)).to_pylist() == [None]


def by_one_edit(words):
    every, out = set(words), {w: set() for w in words}
    letters = sorted({c for w in words for c in w})
    for w in words:
        for i in range(len(w) + 1):
            made = [w[:i] + c + w[i:] for c in letters]
            if i < len(w):
                made += [w[:i] + w[i + 1 :]] + [w[:i] + c + w[i + 1 :] for c in letters]
            out[w] |= (every & set(made)) - {w}
    return out


def test_near_words_by_brute_force(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("aabcé") for _ in range(rng.randint(3, 9))) for _ in range(900)}
    words |= {"a" * k for k in range(7, 40)} | {"b" * 5000, "b" * 5001, "b" * 2000 + "c" + "b" * 3000, "abc" * 900, "abc" * 900 + "x"}
    words = sorted(words)
    df = spark.createDataFrame([(i, w, i + 2) for i, w in enumerate(words)], "id long, word string, n long")
    got = {w: set() for w in words}
    for r in near_words(df).collect():
        assert r["near"] not in got[r["word"]] and r["near_n"] == words.index(r["near"]) + 2
        got[r["word"]].add(r["near"])
    assert got == by_one_edit(words)


def variants_by_brute_force(rows, least_length=7):
    import re

    n = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % 31 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            n[low] = n.get(low, 0) + 1
    n = {w: k for w, k in n.items() if len(w) >= least_length and k >= 2}
    near = by_one_edit(sorted(n))
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), k, len(near[w]), n.get(form[w], -1)) for w, k in n.items())


def test_variants_by_brute_force(spark):
    rng = random.Random(8)
    stems = ["transport", "étonnant", "collection", "ÉTONNANT", "collections", "colection", "Transports", "abcdefg", "xabcdefg", "abcdef"]
    weights = [900, 300, 90, 20, 9, 3, 40, 5, 60, 30]
    rows = [(i, " ".join(rng.choices(stems, weights, k=60)) + ".", "en", "a") for i in range(80)]
    rows += [(None, "transport transporr transporr", "en", "a"), (90, "v" * 3000 + " " + "v" * 3001, "en", "a"), (91, "v" * 3000 + " " + "v" * 3001, "en", None)]
    chain = lambda i: "navigator " * 8 + ("navigatos " if i % 2 else "") + ("navigatoss" if i in (11, 22, 33) else "")
    rows += [(200 + i, chain(i), "en", "a") for i in range(80)]
    rows += hard_rows()
    got = spelling_variants(frame(spark, rows)).collect()
    made = sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in got)
    assert made == variants_by_brute_force([(i, t) for i, t, _, _ in rows])
    assert any(r["form"] for r in got) and any(r["root"] != r["form"] for r in got if r["form"])


def test_variants_of_an_empty_table(spark):
    assert spelling_variants(frame(spark, [])).count() == 0
    assert spelling_variants(frame(spark, [(1, None, None, None), (2, "short", None, None)])).count() == 0


ODD = [
    "", " ", "  two  spaces", "a\nb\n\n c \t d", "don't can't I'll  we've", "x <|endoftext|> y", "foo<|endoftext|>bar <|endoftext|>", "été naïve 中文 \U0001f600 ok",
    "1234 5678,90 a1 b2", "end ", " start", "no break space \u0085 x", "A" * 3000, "word " * 500, "tab\tword word", "a.\n\nWord\nword\n word x\r\ny", "it's 'sword 'Tis l'été d'Été ñandú—és «été» ÿ", "́ combining áb", "a - b -- c --d",
]


def test_pieces_encode_as_whole_texts():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice(" \n\tabZ'é1.,<|> ") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    encoder = Encoder(tokenizer_text(public_tokenizers.path("byte_bpe_50k.json")))
    assert encoder.by_pieces and all("".join(cut_at_words(t)) == t for t in texts)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(e, "<u4").tolist() for e in encoder.encode(texts)] == want
    assert not Encoder(tokenizer_text(public_tokenizers.path("word_bpe_49k.json"))).by_pieces


def test_half_a_million_pieces_are_encoded_once():
    encoder, learned = Encoder(tokenizer_text(public_tokenizers.path("byte_bpe_50k.json"))), []
    real = encoder.learn
    encoder.learn = lambda pieces: learned.append(len(pieces)) or real(pieces)
    letters = "abcdefghij"
    texts = ["".join(" " + "".join(letters[int(d)] for d in str(n)) for n in range(a, a + 20_000)) for a in range(0, 500_000, 20_000)]
    first = encoder.encode(texts[:12]) + encoder.encode(texts[12:])
    before = sum(learned)
    assert encoder.encode(texts[:12]) + encoder.encode(texts[12:]) == first and sum(learned) == before


def digests_by_brute_force(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_round_trip(spark, encoding):
    rng = random.Random(2)
    rows = [(100 + i, " ".join(rng.choice(["alpha", "beta,", "Gamma", "42"]) for _ in range(rng.randint(0, 400)))) for i in range(300)]
    rows += [(2000 + i, t) for i, t in enumerate(ODD)] + [(2900, None), (2901, "very long " * 60_000)]
    mixed = rows[:]
    rng.shuffle(mixed)
    path = tempfile.mkdtemp(prefix="run-") + "/tokens"
    docs = frame(spark, [(i, t, "en", "a") for i, t in mixed]).repartition(7)
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), encoding=encoding, row_group_bytes=6_000, page_bytes=2_000, page_rows=20)
    got = id_checksums(read_tokens(spark, path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == digests_by_brute_force(rows)
    assert [tuple(r) for r in read_metadata(spark, path).orderBy("doc_id").collect()] == [r[:3] for r in digests_by_brute_force(rows)]
    check_layout(path, encoding)


def check_layout(path, encoding):
    import glob

    import pyarrow.parquet as pq

    files = sorted(glob.glob(f"{path}/*.parquet"))
    groups = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        groups = max(groups, meta.num_row_groups)
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                assert column.has_offset_index
                if column.path_in_schema.startswith("ids"):
                    wanted = "DELTA_BINARY_PACKED" if encoding == "delta" else "PLAIN_DICTIONARY"
                    assert wanted in column.encodings
                if column.path_in_schema == "doc_id":
                    assert column.has_column_index
    assert groups > 1


def test_reads_are_selective(spark):
    path = tempfile.mkdtemp(prefix="run-") + "/tokens"
    docs = frame(spark, [(i, f"text number {i} " * 30, "en", "a") for i in range(2000)])
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), row_group_bytes=60_000, page_bytes=3_000, page_rows=50)
    plan = read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    one = read_tokens(spark, path, "doc_id = 1234")
    assert "EqualTo(doc_id,1234)" in one._jdf.queryExecution().executedPlan().toString()
    everything = digests_by_brute_force([(i, f"text number {i} " * 30) for i in range(2000)])
    assert [tuple(r) for r in id_checksums(one).collect()] == [everything[1234]]


def test_token_files_of_hard_rows_and_empty_tables(spark):
    path = tempfile.mkdtemp(prefix="run-")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    write_tokens(frame(spark, hard_rows()), f"{path}/hard", tokenizer)
    got = id_checksums(read_tokens(spark, f"{path}/hard")).orderBy("start").collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert [key(r) for r in got] == sorted(key(r) for r in got) and len(got) == len(hard_rows())
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()
    want = sorted((str(i), n, c) for i, _, n, c in digests_by_brute_force([r[:2] for r in hard_rows()]))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want
    write_tokens(frame(spark, []), f"{path}/none", tokenizer)
    assert id_checksums(read_tokens(spark, f"{path}/none")).count() == 0
