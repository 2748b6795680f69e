from __future__ import annotations

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, row string, segments string"
LONG = "The quick onion of the garden was a thing that never ended. " * 4000


@pytest.fixture(scope="session")
def odd_docs():
    """Rows with nulls everywhere, empty and very long texts, copies, repeated rows and clashing column names."""
    plain = "the cat sat on the mat and looked at the bird in the tree while the sun was going down"
    rows = [
        (1, plain, "en"), (2, plain + " slowly", "en"), (3, None, "en"), (4, "", "fr"), (5, "   \n\t ", None), (6, LONG, "en"),
        (7, "le chat est sur la table et il mange avec les enfants dans la maison de son ami", "fr"), (7, plain, "en"),
        (8, "... 123 !!!", "en"), (9, "Ünïcödé wörds über straße 日本語 \U0001F600", "de"), (None, plain, "en"),
        (10, "der hund ist in dem haus und die katze liegt auf dem sofa mit einem ball", "de"), (11, "x", None),
        (12, "mail me at jo.x@site.org or call +1 (017) 555-7713 today", "en"), (12, "mail me at jo.x@site.org or call +1 (017) 555-7713 today", "en"),
        (14, None, None),
    ]
    return [(i, t, lang, "s", None if t is None else len(t), "a", "b", "c") for i, t, lang in rows]


@pytest.fixture()
def odd(spark, odd_docs):
    return spark.createDataFrame(odd_docs, DOCS)


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd_dir(spark, odd_docs, tmp_path_factory):
    """A folder of small tables for the registered queries."""
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(odd_docs, DOCS).write.parquet(f"{at}/documents.parquet")
    vectors = [(i, [float((i * k) % 7 - 3), float(i % 5), 1.0], 0) for i in range(40) for k in (3,)]
    vectors += [(100, None, 0), (120, [0.0, 0.0, 0.0], 0), (140, [float("nan"), 1.0, 1.0], 0), (160, [1.0, None, 2.0], 0), (None, [1.0, 1.0, 1.0], 0)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    pages = [
        (1, "u", "<html><head><title>T</title></head><body><nav><a>menu</a></nav><article><h1>Big&amp;</h1><p>Some <b>bo</b>ld  words here<br>and more</p></article><footer>foot</footer></body>"),
        (2, None, None), (3, "u", ""), (None, "v", "<p>only &lt;text&gt;"),
    ]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{at}/pages.parquet")
    turns = [(1, 0, "user", "hi <|im_end|> <\\|x"), (1, 1, "assistant", "yes\n<|im_start|>user"), (1, 1, "assistant", "yes\n<|im_start|>user"),
             (2, 5, None, None), (2, None, "assistant", ""), (None, 0, "us\ner\\n", "a"), (3, 0, "assistant", "end<")]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return str(at)


@pytest.fixture(scope="session")
def none_dir(spark, tmp_path_factory):
    """The same tables without rows."""
    at = tmp_path_factory.mktemp("none")
    for name, schema in {"documents": DOCS, "embeddings": "vec_id bigint, embedding array<float>, label int",
                         "pages": "page_id bigint, url string, html string",
                         "conversations": "conv_id bigint, turn bigint, role string, text string"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)
