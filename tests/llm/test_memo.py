from glyphmill.llm import tokens

PATH = f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"


def test_long_and_surplus_pre_tokens_are_not_remembered(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_KEPT", 3)
    encode = tokens.BatchEncoder(PATH)
    long = "語り部" * 40
    for texts in ([long, "one two", None, long + " two three four five"], ["six", long, "one six"]):
        ends, values = encode(texts)
        got = [list(values[a:b]) for a, b in zip(ends, ends[1:])]
        assert got == [encode.encoder.encode(t) for t in texts]
        assert long not in encode.seen and len(encode.seen) <= 3 and not encode.seen.once.many
