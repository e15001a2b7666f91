"""Awkward rows that every document operator has to survive, and plain readings of the contracts."""

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

LONG = " ".join(f"w{k % 997} Ünïcode {k}" for k in range(40_000))
# Thue-Morse sequences of two letters, words and lines with their complements: equal under a polynomial modulo 2^64
SIGNS = [bin(k).count("1") % 2 for k in range(2048)]
TWINS = [
    (100 + 10 * k + flip, "begin " + between.join((one, two)[s ^ flip] for s in SIGNS[:n]) + " and two words")
    for k, (one, two, between) in enumerate([("a", "b", ""), ("yes", "no", " "), ("a line", "one more", "\n"), ("b", "c", " ")])
    for n in (1024, 2048)
    for flip in (0, 1)
]
TWINS += [(200, TWINS[0][1] + "\n" + TWINS[1][1]), (201, " ".join((TWINS[0][1].split()[1], "same", "two", TWINS[1][1].split()[1], "same", "two")))]
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog " * 6 + "\nthe end\nthe end\n"),
    (2, None),
    (3, ""),
    (4, " \t\n\r\n "),
    (None, "a null id\nwith two lines\nwith two lines"),
    (5, LONG),
    (6, LONG),
    (7, "Straße GROẞE naïve café # * $ % & | < > 12345 \x00 \x1c odd"),
    (8, "a b"),
    (9, "the quick brown fox jumps over the lazy dog " * 6 + "\nthe end\nthe end\n"),
    (9, "the quick brown fox jumps over the lazy dog " * 6 + "\nthe end\nthe end\n"),
    (10, "x" * 5000 + "\n" + "y" * 300),
    (11, "Licensed under the Apache  License, Version 2.0.\nMIT-License and the gnu general public licence"),
]


def frame(spark, rows=TEXTS):
    """Documents with columns that clash with the operators' own names."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars", "1 as row", "2 as fp", "3 as n_words", "4 as key")


def real(spark, n="0.001"):
    return spark.read.parquet(f"/root/testdata/sf{n}/documents.parquet")


def keyed(rows):
    return sorted((tuple(r) for r in rows), key=repr)
