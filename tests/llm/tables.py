"""Small tables with nulls, empty and long texts, ties, repeated rows and columns whose names clash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"
#: Names that operators use inside or add.
CLASHES = ["n_words", "kept", "shard", "n_bytes", "h", "k", "w", "words", "at", "id", "label", "component_id", "rep", "n_lines", "n_removed", "_row_k", "_gone", "_gone_k", "_h", "_bytes", "_n", "_real", "row_key", "fence_key", "metric", "ids", "digest", "payload", "said", "low", "_shard", "_v", "_c", "_places", "_dropped", "_cell0", "_depth0", "hit_words", "_hit_words", "_found_key", "ta", "bit", "a", "b"]

LINE = " ".join(f"w{k}" for k in range(30))
OTHER = " ".join(f"x{k}" for k in range(30))
LONG = " ".join(f"long{k % 7919}" for k in range(60_000))


def texts() -> list[str | None]:
    return [
        None,
        "",
        " \t\n\x0b\x0c\r ",
        "one",
        "one two three four",
        "One two three four",
        "Ünï çödé — 漢字かな 漢字かな 🙂 🙂 \u00a0 \u2003 \u0085 ",
        "a b c d e a b c d e",
        "a\x00b \x1f\x7f c\x00",
        "same line\nsame line\n\n  \nsame line \nsame line",
        f"{LINE}\n{OTHER}\nend of the first one here",
        f"start of another\n{LINE}\n{OTHER}\nand its end",
        f"{LINE}\n{OTHER}\n{LINE}\n{OTHER}",
        f"{LINE} {OTHER}",
        f"{LINE} {OTHER}\n{LINE} {OTHER}\n{LINE} {OTHER}",
        LONG,
        LONG + " and a little more",
        "This is CC BY 4.0, cc-by and cc by nc; All Rights Reserved, GNU General Public License version 3 license",
        "cc cc by by cc",
        "x" * 5000,
        "ab" * 3000 + " " + "🙂" * 700,
        "  leading and trailing  ",
        "tabs\tand\r\nnew lines\r\n\r\nmore",
        "don't we'll I'VE 12345 67890123 !!! ??? ... \n\n\n   x",
        "$$$ ### *** | <b> & % " * 12,
    ]


def documents(spark: SparkSession, extra: bool = False) -> DataFrame:
    """With extra, a text column for each clashing name."""
    rows = [(10 + k, t, "en" if k % 3 else None, "web" if k % 4 else None, len(t or "")) for k, t in enumerate(texts())]
    rows += [(None, "a text without an id, of some ten words or a few more", "en", "web", None), (None, None, None, None, None), rows[10], rows[10], rows[3]]
    rows.append((500, rows[10][1], "de", "books", 7))
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return with_clashes(df) if extra else df


def with_clashes(df: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"kept {c}") for c in CLASHES if c not in df.columns})


def unique_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(10 + k, t, "en", "web", len(t or "")) for k, t in enumerate(texts())], DOCS)


def empty(spark: SparkSession, schema: str = DOCS) -> DataFrame:
    return spark.createDataFrame([], schema)


def pages(spark: SparkSession) -> DataFrame:
    big = "<html><body><article><p>" + "Körper 🙂 of text, again and again. " * 60 + "</p></article></body></html>"
    rows = [
        (1, "http://www.Example.COM/en/x?q=/net", big),
        (2, "https://a.example.com/en/y#f", big),
        (3, "//nothing", big),
        (4, None, None),
        (5, "", ""),
        (6, "http://x.net/es/a", "<p>short</p>"),
        (7, "http://x.net/fr", "<p>short</p>"),
        (8, "HTTP://NET/fr/x", big + " "),
        (9, "x://com", "\r\n\r\n"),
        (10, "x://com/", "y" * 999),
        (11, "x://spam.org/a\nb/ads/", "y" * 999),
        (12, "://", "y" * 1000),
        (13, "a://b://c.com/", "y" * 1000),
        (14, "http://notcom/en/", None),
        (15, "http://user:pw@example.com:80/en/", "z" * 3000),
        (16, "http://example.com/en", "z" * 3000),
        (17, "http://sub.example.com/en/\u00fc", "<"),
        (None, "http://no.id/", big),
    ]
    return spark.createDataFrame(rows, PAGES).repartition(3)


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    got = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(got, key=repr)
