"""Patterns of browsers in Java's dialect and in RE2's: golden texts, one by one."""

import duckdb
import pytest
from pyspark.sql import functions as F

from airlock.functions import scan
from airlock.functions.dialect import translated

#: (pattern, texts that it matches, texts that it doesn't), as a browser has it.
GOLDEN = [
    (r"a\sb", ["a b", "a b", "a﻿b", "a　b", "a b", "a\tb", "a\x0bb", "a b", "a b"], ["ab", "a​b", "a\u0085b", "a᠎b", "a\x1cb"]),
    (r"a\Sb", ["axb", "a​b", "a\U0001f600b", "a\u0085b"], ["a b", "a b", "a﻿b"]),
    (r"^[^\s'\"]{3}$", ["abc", "a​c"], ["a c", "a'c", "ab", "abc\n"]),
    (r"[\s,]+x", [" ,x", ",x"], ["x"]),
    (r"end$", ["the end"], ["the end\n", "the end\r", "ends"]),
    (r"(?m)^b$", ["a\nb\nc", "b", "a\nb"], ["ab", "a\x85b\x85c"]),
    (r"a.b", ["a\u0085b", "axb", "a\x0bb"], ["a\nb", "a\rb", "a b"]),
    (r"(?s)a.b", ["a\nb"], ["ab"]),
    (r"[[a]", ["[", "a"], ["b"]),
    (r"[a&&b]", ["&", "a", "b"], ["c"]),
    (r"x{y", ["x{y"], ["xy"]),
    (r"x{2}", ["xx"], ["x{2}"]),
    (r"\h\a\z", ["haz"], ["a", " "]),
    (r"\/\-\:", ["/-:"], ["\\"]),
    (r"\bcat\b", ["a cat.", "cat", "écaté"], ["cats", "_cat"]),
    (r"a[]b", [], ["ab", "a]b", "axb"]),
    (r"a[^]b", ["a\nb", "axb"], ["ab"]),
    (r"é\x41\cJ", ["éA\n"], ["eA\n"]),
    (r"[\b\v]", ["\x08", "\x0b"], ["b", "v", "\n"]),
    (r"(?i)AbC\0", ["abc\x00"], ["abc0"]),
    (r"\w\W\d\D", ["a-1x"], ["é-1x"]),
]


@pytest.mark.parametrize("k", range(len(GOLDEN)))
def test_golden_texts(spark, k):
    pattern, yes, no = GOLDEN[k]
    rows = [(t, True) for t in yes] + [(t, False) for t in no]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert [(r.t, r.got) for r in df.select("t", F.col("t").rlike(translated(pattern)).alias("got")).collect()] == rows
    for text, want in rows:
        if "\x00" not in text:  # DuckDB's bindings end a text there
            assert duckdb.execute("SELECT regexp_matches(?, ?)", [text, translated(pattern, "re2")]).fetchone()[0] == want, (pattern, text)


def test_secrets_around_wide_spaces(spark):
    """What a browser finds: a no-break space may stand around the sign, and ends a password."""
    rows = [
        ("api_key = ABCDEFGHIJKLMNOP1234", "API Key"),
        ("API-KEY﻿:　ABCDEFGHIJKLMNOP1234", "API Key"),
        ("password: hunter2hunter2", "Password"),
        ("password: abc defghij", ""),
        ("password: abc​defghij", "Password"),
        ("bearer = abcdefghij.klmnopqrst-uv", "Token"),
        ("redis://localhost 6379/0", ""),
        ("redis://localhost:6379/0", "Connection String"),
        ("pwd᠎= 123456789", ""),
    ]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [(r.t, r.got) for r in df.select("t", scan.findings_text(F.col("t")).alias("got")).collect()] == rows


def test_own_catalogue_and_errors(spark):
    own = [("Invoice", r"(?i)inv\s*#\s*\d{4,}$"), ("Tag", r"[[]x]")]
    df = spark.createDataFrame([("INV # 1234",), ("inv # 1234\n",), ("a [x]",)], "t string")
    assert [r[0] for r in df.select(scan.findings(F.col("t"), own)).collect()] == [["Invoice"], [], ["Tag"]]
    with pytest.raises(ValueError, match="no dialect"):
        translated("a", "perl")
