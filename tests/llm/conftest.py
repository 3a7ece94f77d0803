import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark, tmp_path_factory):
    """Writes tables into a new folder and gives its path."""

    def write(texts, name="documents", schema=DOCS, rows=None):
        folder = str(tmp_path_factory.mktemp("sf"))
        rows = rows if rows is not None else [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
        return folder

    return write


#: Nulls, empty and very long texts, ties, repeated rows, odd white space, special strings, other scripts.
ODD_TEXTS = [
    None, "", " ", "\n\n", "a", "a a a a a a", "  two  spaces \n\n \n here ", "x" * 5000, "word " * 400, "naïve café 東京タワー ümlaut nbsp em",
    "<|endoftext|> mid <|endoftext|>end", "^hat ^ ^^ hat", "don't WE'LL they've 123 4567 #$%& <tag>", "tab\there\r\nand there\r\n", "same line\nsame line\nother\nsame line\n",
    "The quick brown fox jumps over the lazy dog. " * 30, "The quick brown fox jumps over the lazy dog. " * 30, "\x1c\x85 ​ zero", "a\n b", "a\n  b", "🙂🙂 emoji 🙂",
]
