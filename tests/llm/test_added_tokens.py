"""Texts that hold the tokenizer's added tokens get the library's ids."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from tickerloom.llm import orc_tokens
from tickerloom.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
TEXTS = ["ab <|endoftext|> c", "ab<|endoftext|>", "<|startoftext|>Ab.<|endoftext|>...", "<|ENDOFTEXT|> <|EndOfText|>", "<|endoftext|><|endoftext|>\n<|endoftext |>", "plain"]


def library(text):
    return [*Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, 2]


def test_added_tokens_in_files(spark):
    assert 49407 in library(TEXTS[0])
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    start, got = 0, {r.doc_id: r for r in orc_tokens.round_trip(df, PATH).collect()}
    for i, text in enumerate(TEXTS):
        ids = library(text)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_words_with_added_tokens_equal_whole_texts():
    r = random.Random(5)
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", "Ab", "st1", "É", "İ", ".", "'s", " ", "\n", "日"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(12))) for _ in range(1500)]
    cut, whole = orc_tokens.Encoder(PATH, 2, True), orc_tokens.Encoder(PATH, 2, False)
    assert cut.encode(texts) == whole.encode(texts)


def test_an_added_word_of_letters_or_marks(tmp_path):
    t = Tokenizer.from_file(PATH)
    t.add_special_tokens(["stop", "!!"])
    t.save(path := str(tmp_path / "t.json"))
    texts = ["go stop now", "unstoppable Stop STOP", "what!! stop!!!", "a!!b ok"]
    assert orc_tokens.Encoder(path, 2, True).encode(texts) == orc_tokens.Encoder(path, 2, False).encode(texts)
