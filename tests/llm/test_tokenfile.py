import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plain_text import corpus, frame
from ruleloom.llm.tokenfile import VOCABULARY, Encoder, digests, pack, read_tokens, unpack, write_tokens

ODD = [
    "It's THE end... of-line's 12,5 <|endoftext|> x<|startoftext|>y",
    "don't DON'T we'll 'tis ''s re've",
    "é́ é Ünï İstanbul ΣΑΣ ΑΣ. ﬁ ½ ²  nbsp x ​ zero\x00nul \x1cfs",
    "日本語テキスト のです。 emoji 😀😀 mixed日本abc",
    "a" * 5000 + " " + "!?" * 900,
    "snake_case __init__ a_b {x}|y ~tilde~ `code` \"quote\" (par) [x]",
    "²³ x² Ⅷ ৪",
]


def plain(rows):
    t = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    out, start = [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("bits", [1, 2, 5, 7, 16, 17, 31, 32])
@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_pack_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 2**bits, n).astype(np.uint32)
    raw = pack(ids, bits)
    assert len(raw) == -(-n // 64) * bits * 8
    assert (unpack(raw, bits, 0, n) == ids).all()
    for start in range(0, n, 37):
        assert (unpack(raw, bits, start, min(70, n - start)) == ids[start : start + 70]).all()


def test_encoder_equals_library():
    t, e = Tokenizer.from_file(public_tokenizers.path(VOCABULARY)), Encoder(VOCABULARY)
    texts = ODD + [x or "" for _, x in corpus(200)]
    for _ in range(2):
        for text, raw in zip(texts, e.encode([x.encode() for x in texts])):
            assert np.frombuffer(raw, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_files(spark, tmp_path):
    rows = corpus(150, 4) + [(1000 + i, x) for i, x in enumerate(ODD)] + [(7, "again"), (7, "again"), (None, "no id")]
    path = str(tmp_path / "tokens")
    write_tokens(frame(spark, rows, 4, block=3, payload="x"), path, block_ids=300)
    assert sorted(map(tuple, digests(spark, path).collect()), key=lambda r: r[1]) == plain(rows)
    assert all(r.ids[-1] == 1 for r in read_tokens(spark, path).collect())
    write_tokens(frame(spark, []), path + "0")
    assert digests(spark, path + "0").collect() == []


def test_words_are_remembered_without_what_stands_beside_them():
    """A word beside punctuation or digits is no entry of its own; the ids are the library's."""
    t, e = Tokenizer.from_file(public_tokenizers.path(VOCABULARY)), Encoder(VOCABULARY)
    r = random.Random(5)
    texts = ["hend hend, hend. (hend) hend&&& hend12 12,hend née, Née.", "<|x hend, <|endoftext|>, hend"]
    texts += ["".join(r.choice("abThé É&%*$,.'\"(1²—☃ ́<|>st\t") for _ in range(200)) for _ in range(200)]
    for text, raw in zip(texts, e.encode([x.encode() for x in texts])):
        assert np.frombuffer(raw, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    assert "hend" in e.known and not [x for x in e.known if x.startswith("hend") and x != "hend"]
