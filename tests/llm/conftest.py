import pytest

TEXT = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    """Words that hardly repeat in order, in lines of twelve that end in a full stop."""
    words = [TEXT[(seed * 7 + i * i * 3 + i * seed + i // 5) % 24] + str((seed * 31 + i * 17) % 97) for i in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) + "." for i in range(0, n, 12))


@pytest.fixture(scope="session")
def documents():
    """Documents with every odd case: copies, near copies, shared passages, nulls, empty and short texts, repeated rows."""
    base = [prose(s, 120) for s in range(8)]
    passage = prose(50, 48)
    near = base[0].split()
    near[60] = "changed"
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(20, base[1], "en", "s0"), (21, base[1], "en", None), (22, " ".join(near), "fr", "s1"), (23, base[2].upper(), "en", "s1")]
    rows += [(30, base[3] + "\n" + passage, "de", "s2"), (31, passage + "\n" + prose(60, 60), "de", "s2")]
    rows += [(40, None, None, "s0"), (41, "", "en", None), (42, "  \n\t ", "en", "s1"), (43, "one two three", "en", "s1"), (44, "One TWO three", "en", "s1"), (45, "same same same same same same same same " * 8, "en", "s0")]
    rows += [(None, base[4], "en", "s0"), (50, prose(55, 120), "en", "s0"), (50, prose(55, 120), "en", "s0"), (60, "ünï-cødé \x0b\x0c été " * 20, "fr", "s9"), (70, prose(70, 4000), "en", "s9")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, documents):
    """The documents as a DataFrame, with columns whose names operators might want for themselves."""
    frame = spark.createDataFrame(documents, "doc_id long, text string, lang string, source string")
    extra = {c: frame["doc_id"] for c in ("size", "h", "key", "node", "n_words", "__w", "kept", "target", "words_key", "component")}
    return frame.withColumns(extra)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
