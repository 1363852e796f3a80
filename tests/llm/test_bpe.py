"""BPE with special tokens of another shape, odd inputs and clashing columns, against the library."""

import hashlib
import json

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from freshet.llm import bpe
from freshet.llm.common import tokenizer_path


def test_special_tokens_of_any_shape(tmp_path):
    spec = json.loads(open(tokenizer_path(bpe.VOCABULARY), encoding="utf-8").read())
    renamed = {x["content"]: f"[S{k}]" for k, x in enumerate(spec["added_tokens"])}
    for x in spec["added_tokens"]:
        x["content"] = renamed[x["content"]]
    vocab = spec["model"]["vocab"]
    for old, new in renamed.items():
        if old in vocab:
            vocab[new] = vocab.pop(old)
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec, ensure_ascii=False), encoding="utf-8")
    library, codec = Tokenizer.from_file(str(path)), bpe.Codec(str(path))
    texts = ["plain text", *[f"a {s} b{s}{s}" for s in renamed.values()], "<|endoftext|> is text here", "[S0", ""]
    for text, found in zip(texts, bpe.encoded(codec, pa.array(texts), list)):
        ids = [i for f in found for i in f]
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_whole_texts_clashing_columns_and_empty_tables(spark):
    library = Tokenizer.from_file(tokenizer_path(bpe.VOCABULARY))
    library.no_truncation(), library.no_padding()
    texts = [None, "", " \n", "hello  World", "hello  World", "It's <|endoftext|> so", "word " * 40_000 + "é", "z" * 5000]
    df = spark.createDataFrame([(i if i != 3 else None, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, ids_sha256 string, word int")
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(df).collect())
    want = []
    for t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode_digests(df.limit(0)).count() == 0


ODD = [None, "", " ", "\x1c", "a\x1cb \x1d", "a\x85b\xa0c\u1680d\u2003e\u2028f\u202fg\u205fh\u3000i", "\u2007", "\xc2\x86 \u2010\u200b", "caf\u00e9 cafe\u0301 \u03a3\u03a3 \U0001f600", "<|endoftext|>", "x<|endoftext|><|startoftext|>y <|endoftext|", "It's 12 'll", "z" * 300 + " end", "end\u3000"]


def test_columns_of_words_are_those_of_their_texts():
    for texts in (ODD, ODD[3:4], [None], [""], []):
        words, first = bpe.words_in(pa.array(texts, pa.string()))
        assert [words.to_pylist()[a:b] for a, b in zip(first, first[1:])] == [bpe.words_of(x or "") for x in texts]
    half = pa.array(ODD).slice(5, 4)
    assert bpe.words_in(half)[0].to_pylist() == [w for x in ODD[5:9] for w in bpe.words_of(x)]


@pytest.mark.parametrize("size", [1, 1000])
def test_slices_are_coded_as_whole_columns(monkeypatch, size):
    """Python meets each string once while it is remembered, and what is forgotten is coded again."""
    monkeypatch.setattr(bpe, "SLICE_ROWS", 5)
    library, codec = Tokenizer.from_file(tokenizer_path(bpe.VOCABULARY)), bpe.Codec()
    codec.texts, codec.words, met = bpe.Memory(size), bpe.Memory(size), []
    pieces = codec.pieces
    codec.pieces = lambda texts: pieces(met.append(list(texts)) or met[-1])
    texts = ODD + ["many " * 500 + "words", "many words"] * 4
    found = [ids[a:b].tolist() for ids, ends in bpe.encoded_slices(codec, pa.array(texts)) for a, b in zip(ends, ends[1:])]
    assert found == [library.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert len(codec.texts.texts) <= 2 * size and len(codec.texts.ids) == len(codec.texts.met) == len(codec.texts.texts)
    seen = [w for x in met for w in x]
    assert size == 1 or all(seen.count(w) == 1 for w in set(seen) if len(w.encode()) <= bpe.Memory.SHORT)
    ids, ends = codec.encode(pa.array([], pa.string()))
    assert len(ids) == 0 and np.array_equal(ends, [0])


def test_words_are_counted_by_columns(monkeypatch):
    """Equal texts are cut into words once a slice, and their words count for each."""
    met, codec = [], bpe.codec_of(None)
    monkeypatch.setattr(codec, "pieces", lambda texts, pieces=codec.pieces: pieces(met.append(list(texts)) or met[-1]))
    texts = [None, "It's it's", "don't " * 3 + "x" * 70, "", "it's"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    rows = [(w, n) for out in bpe._word_counts(None)(iter([batch])) for w, n in zip(*(c.to_pylist() for c in out.columns))]
    assert sorted(rows) == [("'s", 3), ("'t", 3), ("don", 3), ("it", 3)] and [sorted(x) for x in met] == [sorted({"It's", "it's", "don't", "x" * 70})]
