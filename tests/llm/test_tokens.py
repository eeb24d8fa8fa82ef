import pytest

from tessera.llm import tokens


@pytest.fixture(scope="module")
def encoded():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in tokens.vocabulary().splitlines() if x)}
    import public_tokenizers

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda t: len(enc.encode_ordinary(t)) if t else 0


TEXTS = [None, "", "one", "Hello, world! 123", "ein Größerer Text  mit\n\nLücken", "word " * 3000, "<|endoftext|>", "x" * 20_000, "it's we'll I'd 'tis", "one"]


def test_brute_force(spark, documents, encoded):
    n = [encoded(t) for t in TEXTS]
    hist = tokens.histogram(tokens.encoded_lengths(documents(TEXTS)))
    rows = {r.n_tokens: r for r in hist.collect()}
    assert set(rows) == set(n)
    for length, r in rows.items():
        assert r.docs == n.count(length)
        assert r.docs_at_least == sum(x >= length for x in n)
        assert r.tokens_at_least == sum(x for x in n if x >= length)
        assert r.truncated_total == sum(min(x, length) for x in n)
        assert r.fitting == sum(x <= length for x in n) / len(n)
    limits = [0, 1, 5, 100, 10**6]
    got = {r.context: r for r in tokens.for_limits(hist, limits).collect()}
    assert all(got[c].truncated_total == sum(min(x, c) for x in n) and got[c].longer == sum(x > c for x in n) for c in limits)
    assert {r.share: r.n_tokens for r in tokens.quantiles(hist, [0.1, 0.5, 1.0]).collect()} == {s: sorted(n)[max(0, round(s * len(n)) - 1)] for s in (0.1, 0.5, 1.0)}


def test_empty_table(spark, documents):
    assert tokens.histogram(tokens.encoded_lengths(documents([]))).count() == 0


def test_parts_join_up(spark):
    lengths = spark.range(3000).selectExpr("id * 7 as n_tokens")
    r = tokens.histogram(lengths).where("n_tokens = 7").first()
    assert r.docs_at_least == 2999
    assert r.tokens_at_least == 7 * sum(range(3000))
