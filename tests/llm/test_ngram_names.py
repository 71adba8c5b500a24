from riskloom.llm import ngram_join


def thue_morse(n: int, letters: str) -> str:
    return "".join(letters[i.bit_count() % 2] for i in range(n))


def test_words_that_polynomials_confuse_stay_apart(spark):
    """Words of 1024 letters and their complements collide in any polynomial modulo 2 ** 64."""
    one, two = thue_morse(1024, "ab"), thue_morse(1024, "ba")
    texts = [(1, one), (2, two), (3, f"{one} {two}"), (4, f"{two} {one}"), (5, f"{one} " * 5 + one), (6, one.upper()), (7, f" {two}\n")]
    got = {r["doc_id"]: (r["n_shingles"], r["class_id"], r["component_id"]) for r in ngram_join.similarity_components(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1, 1), 2: (1, 2, 2), 3: (1, 3, 3), 4: (1, 4, 4), 5: (1, 5, 5), 6: (1, 1, 1), 7: (1, 2, 2)}


def test_long_single_words_and_parts():
    raw = b"x" * (3 << 20) + b" y " + b"ab " * (1 << 19)
    h = ngram_join.word_hashes(raw)
    assert h.shape == ((1 << 19) + 2, 2) and (h[2:] == h[2]).all() and len({tuple(x) for x in h[:3].tolist()}) == 3
    assert (h[1] == ngram_join.word_hashes(b"\ty")[0]).all() and not len(ngram_join.word_hashes(b"")) and not len(ngram_join.word_hashes(b" \n"))
