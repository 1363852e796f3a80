"""WebP of many images at a time against the decoder of single ones."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from freshet.llm import media, webp, webp_batch


def text(n, words=400, seed=1):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}é" for _ in range(n))


BODIES = [b"", b"a", b"\0" * 64, text(90).encode(), b"abcd" * 900, (text(12) + "\n").encode() * 40, bytes(range(256)) * 9, text(9000, seed=2).encode(), np.random.default_rng(1).integers(0, 256, 4096).astype(np.uint8).tobytes(), ("the same line\n" * 300).encode(), ("--" * 700).encode()]


def test_files_read_back_by_both_decoders(monkeypatch):
    payloads = [media.padded(b) for b in BODIES]
    files = media.stored(payloads)
    for p, own in zip(payloads, media.pixels(files)):
        assert b"".join(x.tobytes() for x in own) == p
    assert [b"".join(x.tobytes() for x in webp.decode(f)) for f in files] == payloads
    # Stored forms don't depend on what is coded beside them, and take less room than the samples here.
    assert [media.stored([p])[0] for p in payloads] == files
    assert sum(map(len, files)) < 0.75 * sum(map(len, payloads))


def test_all_parts_of_the_format_are_used(monkeypatch):
    """What the decoder meets in stored texts, counted."""
    seen = {"predictor": set(), "cross": 0, "palette": 0, "literals": 0, "references": 0, "cached": 0}
    undo, colour, palette, values, read = webp_batch.undo_predictors, webp_batch._with_colour, webp_batch._from_palette, webp_batch._values, webp_batch._Codes.read
    monkeypatch.setattr(webp_batch, "undo_predictors", lambda r, m, b: [seen["predictor"].update(np.unique(x).tolist()) for x in m] and undo(r, m, b))

    def count(name, f):
        def run(*a):
            seen[name] += 1
            return f(*a)

        return run

    def symbols(self, bits, stream, code):
        out = read(self, bits, stream, code)
        if self.symbols.shape[1] > 256:
            seen["literals"] += int((out < 256).sum())
            seen["cached"] += int((out >= 280).sum())
        return out

    monkeypatch.setattr(webp_batch, "_with_colour", count("cross", colour))
    monkeypatch.setattr(webp_batch, "_from_palette", count("palette", palette))
    monkeypatch.setattr(webp_batch, "_values", count("references", values))
    monkeypatch.setattr(webp_batch._Codes, "read", symbols)
    ramp = np.add.outer(np.arange(64), np.arange(16))[..., None] * np.array([1, 1, 1, 0]) % 256  # channels move together
    payloads = [media.padded(b) for b in BODIES] + [ramp.astype(np.uint8).tobytes()]
    media.pixels(media.stored(payloads))
    assert len(seen["predictor"]) > 1 and all(seen.values())


@pytest.mark.parametrize("seed", range(8))
def test_images_of_any_kind(seed):
    rng, files, images = np.random.default_rng(seed), [], []
    for k in range(9):
        h, w, b = int(rng.integers(1, 18)), int(rng.integers(1, 22)), int(rng.integers(2, 5))
        image = rng.integers(0, (256, 3, 40)[k % 3], (h, w, 4)).astype(np.uint8)
        size = (-(-h >> b), -(-w >> b))
        transforms = [("predictor", b, rng.integers(0, 14, size).astype(np.uint8)), ("cross", b, rng.integers(0, 256, (*size, 3)).astype(np.uint8)), ("green",)]
        chosen = [("palette",)] if k % 3 == 1 and len(np.unique(image.reshape(-1, 4), axis=0)) <= 256 else [transforms[j] for j in rng.permutation(3)[: k % 4]]
        groups = rng.integers(0, 3, (-(-h >> 2), -(-w >> 2))) if k == 8 else None
        files.append(webp.encode_pixels(image, tuple(chosen), int(rng.integers(0, 6)), groups, 2, bool(k % 2)))
        images.append(image)
    assert all((a == b).all() for a, b in zip(webp_batch.decode_many(files), images))


def test_broken_streams_are_refused():
    file = media.stored([media.padded(b"hello " * 60)])[0]
    for bad in (file[:30], b"RIFF" + file[4:16] + b"XXXX" + file[20:], b"x" * 40):
        with pytest.raises(webp.Broken):
            webp.decode(bad)
        with pytest.raises(webp.Broken):
            media.pixels([bad])
    short = file[:4] + (len(file) - 48).to_bytes(4, "little") + file[8:16] + (len(file) - 60).to_bytes(4, "little") + file[20:-40]
    for read in (webp.decode, lambda f: media.pixels([f])):
        with pytest.raises(webp.Broken):
            read(short)


def test_query_on_odd_rows(spark):
    texts = [None, "", "x", "x", text(30), text(5000), "é" * 40]
    df = spark.createDataFrame([(i if i != 3 else None, t, 1, "m") for i, t in enumerate(texts)] + [(2, "x", 1, "m")], "doc_id long, text string, n_bytes int, media string")
    got = media.media_features(media.to_media(df)).collect()
    assert len(got) == 8 and len({tuple(r)[1:] for r in got if r["n_bytes"] == 1}) == 1
    for r in got:
        if r["doc_id"] is not None:
            p = media.padded((texts[r["doc_id"]] or "").encode())
            assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


def test_codes_are_looked_up_by_their_first_bits():
    """Short codes, longer ones and codes without bits, each with the table and by its limits."""
    lengths = np.zeros((3, 20), np.int64)
    lengths[0, :12] = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 11]
    lengths[1, 7] = 1
    lengths[2, [3, 9, 1]] = [1, 2, 2]
    codes = webp_batch._Codes(lengths)
    assert codes.short.size == 3 << webp_batch.SHORT
    for k, symbols in ((0, range(12)), (1, [7]), (2, [3, 9, 1])):
        texts = webp_batch._texts(lengths[k].tolist())
        for s in symbols:
            bits = webp_batch._Bits([int(texts[s][::-1] or "0", 2).to_bytes(2, "little") + bytes(8)])
            assert codes.read(bits, np.array([0]), np.array([k])).tolist() == [s] and bits.at.tolist() == [len(texts[s])]
