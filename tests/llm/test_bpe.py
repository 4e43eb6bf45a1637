import hashlib
import random

import pyarrow as pa
import pytest

from gridloom.llm import bpe, text

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    path = bpe.vocabulary_path()
    return bpe.Bpe(path), tokenizers.Tokenizer.from_file(path)


def texts():
    rng = random.Random(5)
    pick = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 900), rng.randrange(0x4E00, 0x4F00), 0x1F600, 9, 10, 13, 32, 32, 39, 39, 115, 116, 108, 0x85, 0xA0, 0x1C]))
    fixed = ["", " ", "\n\n  a", "it's we'll I'D ''s !'s 's's 'lla 're", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endof", "a" * 5000, " " * 300, "日本語テキスト" * 50, "x\x85y", None]
    return fixed + ["".join(pick() for _ in range(rng.randrange(300))) for _ in range(300)]


def test_same_as_library_by_word_and_by_chunk(both):
    ours, library = both
    column = pa.array(texts())
    got = []
    for _, _, data, offsets in text.chunks(column, 2000):
        ids, at = ours.encode_chunk(data, offsets)
        got += [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])]
    for value, ids in zip(column.to_pylist(), got, strict=True):
        want = library.encode(value or "", add_special_tokens=False).ids
        assert ids == want == ours.encode(value or "")
        assert ours.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_broken_utf8_decodes_as_library(both):
    ours, library = both
    ids = [ours.ids[b"\xc3"], ours.ids[b"a"], 50256, ours.ids[b"\xa9"]]
    assert ours.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_query_with_nulls_repeats_and_extra_columns(spark, both):
    _, library = both
    rows = [(1, "ab c", 7), (1, "ab c", 7), (None, None, 8), (2, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, bpe.digest_documents(df, bpe.vocabulary_path()).collect()), key=str)

    def want(i, t):
        e = library.encode(t or "", add_special_tokens=False).ids
        return i, len(e), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()

    assert got == sorted((want(i, t) for i, t, _ in rows), key=str)
    assert bpe.digest_documents(df.limit(0), bpe.vocabulary_path()).count() == 0
    whole = bpe.encode_documents(df, bpe.vocabulary_path()).where("doc_id = 1").first()
    assert whole.decoded == "ab c" and list(whole.ids) == library.encode("ab c").ids
