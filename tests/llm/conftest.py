import numpy as np
import pytest

LONG = "wordy " * 9000 + "end"
PASSAGE = " ".join(f"passage{k % 17}x{k}" for k in range(60))


def documents():
    """Copies, near copies, shared passages, personal data, nulls, empty and very long texts, odd spaces, repeated rows."""
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghijklmnoprstuvwz"), rng.integers(2, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words, n))
    rows = [(1, None), (2, ""), (3, " "), (4, "one two"), (5, "ONE two"), (6, "one two"), (7, LONG), (8, LONG), (9, LONG[:-3] + "other"), (10, "a" * 1500), (11, "ab" * 900)]
    base = text(120).split(" ")
    for k in range(12, 24):
        near = list(base)
        near[3 * (k - 12)] = f"changed{k}"
        rows.append((k, " ".join(near)))
    rows += [(24, " ".join(base)), (25, " ".join(base)), (25, " ".join(base)), (26, " ".join(base[:60]))]
    rows += [(k, text(40) + " " + PASSAGE + " " + text(30)) for k in range(27, 32)]
    rows += [(32, "mail joe.x+y@mail.example.com or +1 (415) 555-0100, 10.0.0.255 and 300.1.1.1 card 4111 1111 1111 1111 end a@b.c_d@e.f 1.2.3.4.5"), (33, "é ü 𝒳 x@y.zz +49 (0)30 1234567 4012888888881881"), (34, "<|endoftext|> <s> ▁x  y \n \t z "), (35, "日本語 テキスト " * 20), (36, "x y　z \x0b\x0c w\x1c v")]
    rows += [(k, text(int(rng.integers(1, 90)))) for k in range(37, 80)]
    rows += [(80, rows[40][1]), (81, text(7)), (81, text(8)), (82, "zzz " * 700), (83, "\n".join(["same line here now"] * 40))]
    return rows


#: Whole columns, and names that the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, h long, node long, score double, kept boolean, row long, n int, doc_id_2 long, base string, `all` string, embedding string"


@pytest.fixture(scope="session")
def docs_rows():
    return documents()


@pytest.fixture(scope="session")
def sf_dir(spark, tmp_path_factory, docs_rows):
    root = tmp_path_factory.mktemp("tables")
    nothing = (None,) * 11
    rows = [(i, t, None if i % 3 else "en", None, None, *nothing) for i, t in docs_rows]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 == 0) if i % 5 else None) for i, _ in docs_rows] + [(None, 1), (999, 0)], "doc_id long, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{root}/embeddings.parquet")
    return str(root)
