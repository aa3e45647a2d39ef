import random

import pytest
import tiktoken

import __spark_entry__
from glyphmill.llm import tokens

PATH = f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"
LONG = "語り部" * 40


def test_p6_is_registered_and_all_documents_come_out(spark, tmp_path):
    assert "p6_ids" in __spark_entry__.queries()
    texts = ["Hello world<|endoftext|>", None, "", "سلام دنیا", LONG]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.ids for r in __spark_entry__.queries()["p6_ids"](spark, str(tmp_path)).collect()}
    vocab = tokens.read_ranks(PATH)
    assert got[1] == got[2] == [] and sorted(got) == [0, 1, 2, 3, 4]
    for i, text in enumerate(texts):
        assert b"".join(vocab[x] for x in got[i]).decode() == (text or "")


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_ids_are_those_of_the_public_library(name):
    path = f"{tokens.TOKENIZERS}/{name}.tiktoken"
    encode = tokens.BatchEncoder(path)
    vocab = tokens.read_ranks(path)
    assert all(encode.encoder.hash.get(x) == i for i, x in enumerate(vocab)) and encode.encoder.hash.get(b"no entry") == -1
    other = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks={x: i for i, x in enumerate(vocab)}, special_tokens={})
    made = random.Random(3)
    texts = ["".join(made.choice("ab e\n 1.,'sسلام駅🙂é<|endoftext|>") for _ in range(made.randrange(60))) for _ in range(300)] + ["x" * 20_000, " " * 500]
    ends, values = encode(texts)
    assert [values[a:b].tolist() for a, b in zip(ends, ends[1:])] == [other.encode_ordinary(x) for x in texts]


def test_keys_keep_their_name_and_empty_tables_pass(spark):
    df = spark.createDataFrame([(7, "a", 1)], "case_no bigint, text string, ids int")
    assert tokens.encode_corpus(df, "case_no", "text", PATH).columns == ["case_no", "ids"]
    assert tokens.encode_corpus(df.limit(0), "case_no", "text", PATH).count() == 0
