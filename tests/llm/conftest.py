import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node string, region int, part string, drop int, block int, slot int, n_lines int, lang_pred string, keep string, curve string, line string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def full(rows):
    return [(i, t, lang, source, len(t or ""), "k", "n", 1, "p", 2, 3, 4, 5, "q", "y", "c", "l") for i, t, lang, source in rows]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows."""
    rng = random.Random(1)
    base = words(rng, 60)
    long_line = "this line is long enough to be counted as repeated text"
    rows = [(i, f"{words(rng, 30)}\n  {long_line.upper() if i % 2 else long_line}\t\n{words(rng, 5)}", "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None) for i in range(8)]
    rows += [(100, base, "en", "s0"), (101, base + " one more", "en", "s0"), (102, base, "fr", "s1"), (102, base, "fr", "s1")]
    rows += [(None, None, None, None), (None, "", "en", "s0"), (103, None, "en", "s0"), (104, "", "fr", None), (105, " \n\t ", "en", "s0"), (106, "x", "en", "s0"), (107, "123 !!", None, "s0")]
    rows += [(108, words(rng, 250_000, 5000), "en", "s0"), (109, "é" * 700_000, "fr", "s1"), (110, "\n" * 3000, "en", "s2"), (100, "another text with the same id", "en", "s0")]
    return full(rows)


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf(tmp_path_factory, spark):
    """A folder of tables as the driver's, with few documents."""
    rng = random.Random(3)
    syllables = {"en": ["the", "and", "ing", "tion", "er"], "fr": ["eau", "ment", "la", "oi", "é"], "de": ["sch", "ung", "ein", "ü", "keit"]}
    rows = []
    for i in range(240):
        lang = ("en", "fr", "de")[i % 3]
        rows.append((i, "\n".join(" ".join("".join(rng.choices(syllables[lang], k=2)) for _ in range(rng.randrange(3, 30))) + "." for _ in range(rng.randrange(1, 6))), lang, f"src{i % 4}"))
    rows += [(300 + i, rows[i][1], rows[i][2], "src0") for i in range(20)] + [(400, None, None, None), (401, "", "en", "src0"), (402, "77", "de", None)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(full(rows), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), int(i % 7 == 0)) for i in range(0, 240, 2)] + [(None, None, None), (0, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)
