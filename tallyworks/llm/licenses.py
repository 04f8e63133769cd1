"""Licence recognition by sentences.

A text is cut into sentences, sentences are normalised (lower case, runs of other characters than letters
and digits become one space) and mapped to the identifiers of known licence sentences. The identifiers of
a text, in order, are matched against an ordered list of rules: a rule names a licence and the sentences,
next to each other, that state it. What a rule matches is used up, so rules of several sentences come
before those of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences that state licences, normalised.
SENTENCES = {
    "apache-grant": "licensed under the apache license version 2 0",
    "apache-limit": "you may not use this file except in compliance with the license",
    "apache-long": "licensed under the apache license version 2 0 the license",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related rights to this work",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "mit-grant": "released under the mit license",
    "mit-long": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mpl2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "rights": "all rights reserved",
}

# Rules in order of precedence.
RULES = [
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("Apache-2.0", ["apache-long", "apache-limit"]),
    ("Apache-2.0", ["apache-grant", "apache-limit"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-3.0-only", ["gpl3-work"]),
    ("Apache-2.0", ["apache-long"]),
    ("Apache-2.0", ["apache-grant"]),
    ("MIT", ["mit-long"]),
    ("MIT", ["mit-grant"]),
    ("BSD", ["bsd-grant"]),
    ("MPL-2.0", ["mpl2"]),
    ("CC-BY-4.0", ["cc-by-long"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC0-1.0", ["cc0"]),
    ("all-rights-reserved", ["rights"]),
]

# Sentences and rules of whole notices, known beside the fixed values where notices are read.
NOTICE_SENTENCES = {
    "apache-notice": SENTENCES["apache-long"] + " " + SENTENCES["apache-limit"],
    "mit-notice": SENTENCES["mit-long"]
    + " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
}
NOTICE_RULES = [("Apache-2.0", ["apache-notice"]), ("MIT", ["mit-notice"])]

#: Ends of sentences: marks and white space behind them, or line ends.
SENTENCE_END = r"[.!?]+[ \t\r\f]*\n|[.!?]+[ \t\r\f]+|\n+"
#: The same for an engine that goes back in a match: only the first mark of a run may start one.
SENTENCE_END_ONCE = r"(?<![.!?])[.!?]++[ \t\r\f]*+\n|(?<![.!?])[.!?]++[ \t\r\f]++|\n++"
OTHER = r"[^\p{L}\p{N}]+"


def normalise(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), OTHER, " "))


def unwrapped(text: Column) -> Column:
    """The text with the lines of a paragraph on one line: only blank lines and starts of list items
    still break it. The mark of ``v. 2`` ends no sentence and goes."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"(?<!\n)\n(?![ \t\f]*(\n|[-*•][ \t]|\(?[0-9a-z]{1,2}[.)][ \t]))(?<!\n[ \t\f]{1,99}\n)", " ")
    return F.regexp_replace(text, r"(?i)\b(v)\.[ \t\f]*(?=[0-9])", "$1 ")


def scan(docs: DataFrame, notices: bool = False) -> DataFrame:
    """All columns of ``docs`` (text and any others) with ``n_sentences`` (with a letter or digit),
    ``n_known`` (licence sentences), ``sequence`` (their identifiers in order, separated by spaces, ``-`` for
    anything between) and ``licenses`` (names in order of the rules, separated by commas, each once). These
    replace columns of the same name.

    A null or empty text has no sentences. Rows are judged one by one, also repeated ones. An empty table
    gives an empty result.

    With ``notices``, texts are ``unwrapped`` first and the sentences of whole notices are known too.
    """
    sentences_of = SENTENCES | NOTICE_SENTENCES if notices else SENTENCES
    rules_of = [*NOTICE_RULES, *RULES] if notices else RULES
    known = F.create_map(*(F.lit(x) for name, sentence in sentences_of.items() for x in (sentence, name)))
    longest = max(map(len, sentences_of.values()))
    row = docs.select(F.struct("*").alias("row"))
    text = F.coalesce("row.text", F.lit(""))
    parts = F.split(unwrapped(text) if notices else text, SENTENCE_END_ONCE)
    sentences = F.filter(F.transform(parts, normalise), lambda s: s != "")
    name = F.transform(
        F.col("sentences"),
        lambda s: F.when(F.length(s) <= longest, F.coalesce(known[s], F.lit("-"))).otherwise("-"),
    )
    named = row.select("row", sentences.alias("sentences")).select(
        "row", F.size("sentences").cast("long").alias("n_sentences"), name.alias("names")
    )
    # Runs of unknown sentences become one mark, so most texts come down to it.
    text = F.regexp_replace(F.concat(F.lit(" "), F.array_join("names", " "), F.lit(" ")), r"( -)+ ", " - ")
    counted = named.select(
        "row",
        "n_sentences",
        F.size(F.filter("names", lambda n: n != "-")).cast("long").alias("n_known"),
        F.trim(text).alias("sequence"),
    )
    # Blanks are doubled, so that neighbours do not share one.
    rest = F.concat(F.lit(" "), F.replace("sequence", F.lit(" "), F.lit("  ")), F.lit(" "))
    steps = counted.withColumn("rest", rest).withColumn("found", F.array().cast("array<string>"))
    state = F.struct("rest", "found")
    rules = F.array(*(F.struct(F.lit(n).alias("name"), F.lit("".join(f" {s} " for s in ids)).alias("ids")) for n, ids in rules_of))

    def apply(held: Column, rule: Column) -> Column:
        hit = F.contains(held["rest"], rule["ids"])
        return F.struct(
            F.replace(held["rest"], rule["ids"], F.lit(" ")).alias("rest"),
            F.when(hit, F.array_append(held["found"], rule["name"])).otherwise(held["found"]).alias("found"),
        )

    licences = F.when(
        F.col("n_known") > 0, F.array_join(F.array_distinct(F.aggregate(rules, state, apply)["found"]), ",")
    ).otherwise("")
    out = ("n_sentences", "n_known", "sequence", "licenses")
    names = [c for c in docs.columns if c not in out]
    return steps.select(
        *(F.col("row").getField(c).alias(c) for c in names), "n_sentences", "n_known", "sequence", licences.alias("licenses")
    )
