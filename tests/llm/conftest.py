import random

import pytest

# Columns whose names the operators use inside, and one with a dot.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row string, id string, size string, "
    "place string, copies string, `a.b` string, ids string, fp string, label string"
)


def documents():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(400)]

    def prose(n, per_line=12):
        out = [rng.choice(words) for _ in range(n)]
        return "\n".join(" ".join(out[k : k + per_line]) for k in range(0, n, per_line))

    shared = prose(72)
    texts = [prose(rng.randint(1, 260)) for _ in range(60)]
    texts += [prose(40) + "\n" + shared + "\n" + prose(30) for _ in range(6)]
    texts += [texts[40]] * 5  # exact copies
    base = prose(300).split(" ")
    for k in range(6):  # near copies: a word in forty or fewer differs
        near = list(base)
        near[7 + 5 * k] = "other"
        texts.append(" ".join(near))
    texts += ["", None, " \n\t ", "one", "two words", "A B c", "a b C", "é☃ \x1c ü x", "x" * 5000, "w " * 30_000, prose(20_000)]
    texts += ["#$% &*| <> " * 30, "same same same " * 50, "line\n\nline\n", "<|im_end|>" * 3]
    extra = (None, "r", "1", "2", None, "3", "4", "5", "6")
    rows = []
    for k, text in enumerate(texts):
        lang = ["en", "de", None][k % 3]
        source = ["s1", "s0", None, "é", "s1"][k % 5]
        rows.append((k, text, lang, source, len(text or "")) + extra)
    rows += [(None, "a null id", "en", "s1", 9) + extra, (None, None, None, None, None) + (None,) * 9]
    rows += [rows[3], rows[3], (3, "same id, other text", "en", "s0", 19) + extra]  # repeated rows
    return rows


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(documents(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def edge_dir(docs):
    """A folder with ``documents.parquet``, as a query's ``sf_dir``."""
    return docs.inputFiles()[0].removeprefix("file://").rsplit("/documents.parquet", 1)[0]


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def empty_dir(spark, no_docs, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    no_docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{root}/embeddings.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{root}/conversations.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)
