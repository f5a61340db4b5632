"""Rows that every operator must take."""

ODD = [
    (None, "a row without an id writes to max@host.example.org"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one two"),
    (5, "the same row twice, mit license"), (5, "the same row twice, mit license"), (6, "the same row twice, mit license"),
    (7, "!!! --- !!!"), (8, "word " * 60_000), (9, "ünï cödé 漢字 😀 text</s><|endoftext|> with [INST] marks +1 (222) 555-0199"),
    (10, "x" * 20_000), (11, "1 2 3 4 5 6 7 8 9 10 " * 50), (12, "line\nline\nline\nother\n"), (-3, "negative ids come last of all"),
]
CLASHING = ["gid", "tag", "bands", "stats", "whole_text", "size", "shard", "spot", "key", "n", "part", "ids", "print", "item", "masked"]
