"""Rows that every operator has to take."""

#: Rows with nulls, empty and blank texts, repeats, ties and odd characters.
ODD = [
    (1, "Hello world, this is a text.\nSecond line here with more words.", "en", "a"), (2, None, None, None), (3, "", "en", ""), (4, " \t\n", None, "b"), (5, "hello WORLD, this is a text.\nSecond line here with more words.", "en", "a"),
    (5, "hello WORLD, this is a text.\nSecond line here with more words.", "en", "a"), (None, "Hello world, this is a text.\nSecond line here with more words.", "en", None), (None, None, "xx", "c"), (6, "\u00c9t\u00e9 \u65e5\u672c\u8a9e \U0001f600 \x1c \x00 end", "fr", "a"), (6, "another text of the same id", "en", "b"),
    (7, "12345 !!! 678", "en", "a"), (8, "word " * 30_000, "en", "a"), (9, "x" * 60_000, "de", "b"), (10, "line one of some words here\n" * 40, "en", "c"),
]
