import random

import public_tokenizers
import pytest
from conftest import SF_SMALL
from inclusio.llm.token_count import load_merger, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_hard_texts_as_the_library(library):
    texts = ["", "  ", "a" * 5001, "aaa aaaa a", "ΣΑΣ ΟΔΥΣΣΕΥΣ", "İI ı ß ẞ", "x<|endoftext|>y<|startoftext|><|endoftext|", "\x1c a\x85b\xa0c d",
             "é ẛ̣ 각", "😀👩‍👩‍👧 1234５６ ½ ²", "日本語テキスト", "\x00\x01", "don't I'LL we're 'S ſ", "it's'dx", "\U00013808 a\U0001385cb"]
    assert load_merger(PATH).count_texts(texts) == library(texts)


def test_random_texts_as_the_library(library):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abcdeé AB1 .!'st<|>\n\t") for _ in range(rnd.randrange(1, 80))) for _ in range(1500)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0xA0, 0x250), rnd.randrange(0x400, 0x600), rnd.randrange(0x4E00, 0x9FFF)]))
                      for _ in range(rnd.randrange(1, 40))) for _ in range(1500)]
    assert load_merger(PATH).count_texts(texts) == library(texts)


def test_query_as_the_library(spark, library):
    from inclusio.llm.catalog import op10_token_counts
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = op10_token_counts(spark, SF_SMALL).collect()
    want = dict(zip(texts, library(list(texts.values()))))
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {d: (len(t.encode()), want[d], want[d] > 2048) for d, t in texts.items()}


def test_odd_rows(odd_docs, no_docs, library):
    got = token_counts(odd_docs).collect()
    want = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted([(r.doc_id, r.n_tokens) for r in got], key=key) == sorted(zip([d for d, _ in want], library([t for _, t in want])), key=key)
    assert token_counts(no_docs).collect() == []


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ab", "aaab", "日本語éß"])
def test_long_pre_tokens_as_the_library(library, letters):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice(letters) for _ in range(n)) for n in (100, 511, 512, 513, 2000, 9000)]
    assert load_merger(PATH).count_texts(texts) == library(texts)


def test_long_pre_tokens_take_time_in_proportion():
    import time
    merger, rnd, took = load_merger(PATH), random.Random(7), []
    merger.count_texts(["x" * 600])  # builds the table of pairs
    for n in (40_000, 80_000):
        word = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        began = time.perf_counter()
        merger.count_texts([word])
        took.append(time.perf_counter() - began)
    assert took[1] < 2.3 * took[0] + 0.2
