"""Licence scan by a positional index of rare words, with DataFrame functions only.

Templates are word sequences of licence notices and bodies, in their versions. The index has, for each template word, its postings
(template, position). Of each file, the mandatory words of each licence with the highest inverse document frequency are looked up;
postings that agree on the relative position (file position less template position) are intersected, and a
placement of a template that at least two rare words agree on is verified: all its mandatory key
phrases have to stand there word by word. Since all mandatory words of a placement that can be verified are in the file, its
rarest ones agree on it: no such placement is missed. Texts are read twice, for the document frequencies and for the look-up, which
happens in each row: nothing but the counts of the templates' words is shuffled.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases of the plain scan and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOTICES = [
    ("gpl-notice", "licensed under the gnu general public license version", ["gnu general public license", "licensed under"]),
    ("gpl-notice", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license", "free software foundation"]),
    ("lgpl-notice", "under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("lgpl-notice", "under the terms of the gnu library general public license", ["gnu library general public license"]),
    ("agpl-notice", "under the terms of the gnu affero general public license", ["gnu affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("mit-notice", "released under the mit license", ["under the mit license"]),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1 the license", ["mozilla public license version 1 1"]),
    ("artistic-2.0", "under the terms of the artistic license 2 0", ["artistic license 2 0"]),
    ("cddl", "subject to the terms of the common development and distribution license the license", ["common development and distribution license"]),
    ("boost-1.0", "distributed under the boost software license version 1 0", ["boost software license version 1 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
]
#: Bodies, each with phrases that a whole copy has near its beginning, middle or end.
BODIES = [
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is "
        "without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or "
        "copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other "
        "dealings in the software",
        ["permission is hereby granted free of charge", "use copy modify merge publish distribute sublicense and or sell copies"],
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all "
        "copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        ["distribute this software for any purpose with or without fee is hereby granted"],
    ),
    (
        "bsd-2-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above "
        "copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in "
        "the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is",
        ["redistribution and use in source and binary forms", "redistributions in binary form must reproduce the above copyright notice", "with the distribution this software is provided"],
    ),
    (
        "bsd-3-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above "
        "copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in "
        "the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission",
        ["redistribution and use in source and binary forms", "may be used to endorse or promote products derived from this software without specific prior written permission"],
    ),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        ["apache license version 2 0", "unless required by applicable law or agreed to in writing software distributed under the license"],
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        ["mozilla public license v 2 0 if a copy of the mpl was not distributed with this file"],
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone "
        "to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        ["without any express or implied warranty in no event will the authors be held liable", "permission is granted to anyone to use this software for any purpose"],
    ),
]


def versions() -> list[tuple[str, str, list[str]]]:
    """Notices that differ in version and kind only."""
    out = []
    for kind, label, numbers in (("general", "gpl", ("1", "2", "3")), ("lesser general", "lgpl", ("2 1", "3")), ("library general", "lgpl", ("2",)), ("affero general", "agpl", ("3",))):
        for v in numbers:
            either = f"either version {v} of the license"
            text = f"it under the terms of the gnu {kind} public license as published by the free software foundation {either} or at your option any later version"
            out.append((f"{label}-{v.replace(' ', '.')}-or-later", text, [f"gnu {kind} public license", either]))
            text = f"it under the terms of the gnu {kind} public license version {v} as published by the free software foundation"
            out.append((f"{label}-{v.replace(' ', '.')}-only", text, [f"gnu {kind} public license version {v} as published by"]))
    rights = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}
    for kind in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
        for v, port in (("3 0", "unported"), ("4 0", "international")):
            label = f"cc-{kind} {v[0]}.{v[2]}".replace(" ", "-")
            out.append((label, f"licensed under cc {kind} {v}", [f"cc {kind} {v}"]))
            name = " ".join(rights[r] for r in kind.split())
            out.append((label, f"licensed under a creative commons {name} {v} {port} license", [f"creative commons {name} {v} {port} license"]))
    for v in ("1 0", "2 0"):
        out.append((f"epl-{v[0]}.{v[2]}", f"made available under the terms of the eclipse public license v {v}", [f"eclipse public license v {v}"]))
    return out


#: (label, text, mandatory key phrases). A licence may have several forms.
TEMPLATES = NOTICES + BODIES + versions()
RARE = 4
#: The index is a constant of the plan; more postings than these would need a join.
MOST_POSTINGS = 100_000
VOCABULARY = sorted({w for _, t, _ in TEMPLATES for w in t.split()} | {w for p in PHRASES for w in p.split()})
#: Every phrase and every template's mandatory phrases have one of these, so that a file without them has no place of either.
GATES = ["license", "cc by", "is hereby granted", "redistribution and use", "public domain", "neighboring rights", "permission is granted to anyone"]


def _key_places(template: str, phrases: list[str]) -> list[int]:
    words, out = template.split(), []
    for p in phrases:
        k = p.split()
        at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
        out += range(at, at + len(k))
    return out


def template_words() -> list[tuple[int, str, int, str, bool]]:
    """(template, label, position, word, mandatory) of every template word."""
    out = []
    for t, (label, text, keys) in enumerate(TEMPLATES):
        places = set(_key_places(text, keys))
        out += [(t, label, k, w, k in places) for k, w in enumerate(text.split())]
    if len(out) > MOST_POSTINGS:
        raise ValueError(f"{len(out)} postings are too many for a constant")
    return out


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_text(text: Column) -> Column:
    """A text's words, with a space before, between and after; only spaces where there are none."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def phrase_places(parts: list[str]) -> Column:
    """Starts of a phrase among ``hits``: all its words are in the vocabulary, so its hits follow each other."""

    def stands(h: Column, i: Column) -> Column:
        ok = h["w"] == parts[0]
        for k, w in enumerate(parts[1:], 1):
            then = F.get("hits", i + k)
            ok = ok & (then["w"] == w) & (then["p"] == h["p"] + k)
        return F.coalesce(ok, F.lit(False))

    return F.transform(F.filter("hits", stands), lambda h: h["p"])


def frequencies(spaced: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows of ``s`` (words between spaces), and how many have each word of the vocabulary (one row a word reaches the driver)."""
    known = F.array(*[F.lit(w) for w in VOCABULARY])
    seen = F.concat(F.array_intersect(F.split("s", " "), known), F.array(F.lit("")))  # the empty word counts the rows
    counts = {r["w"]: r["n"] for r in spaced.select(F.explode(seen).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return counts.pop("", 0), counts


INDEX = "array<struct<label:string,full:double,musts:array<struct<w:string,ks:array<int>>>,keys:array<struct<w:string,k:int>>,words:array<struct<w:string,k:int,idf:double>>>>"


def index(rows: int, frequency: dict[str, int]) -> Column:
    """The templates as a constant: label, weight in all, mandatory words from the rarest on with their positions (the postings), mandatory
    places, and all words with place and weight."""
    templates: dict[int, dict] = {}
    for t, label, k, w, must in template_words():
        idf = math.log((rows + 1) / (frequency[w] + 1)) if w in frequency else math.log(2.0)
        out = templates.setdefault(t, {"label": label, "full": 0.0, "musts": {}, "keys": [], "words": []})
        out["full"] += idf
        out["words"].append({"w": w, "k": k, "idf": idf})
        if must:
            out["keys"].append({"w": w, "k": k})
            out["musts"].setdefault(w, (-idf, w, []))[2].append(k)
    for out in templates.values():
        out["musts"] = [{"w": w, "ks": ks} for _, w, ks in sorted(out["musts"].values())]
    return F.from_json(F.lit(json.dumps(list(templates.values()))), INDEX)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the weight of the template words that stand in their places, as a share of the template's, of the best
    verified placement; 0 without one. A null or empty text has no words and no labels; repeated rows
    give repeated results, a null key is carried; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("key"), words_text(F.col(text)).alias("s"))
    templates = index(*frequencies(rows.select("s")))
    gate = F.lit(False)
    for g in GATES:
        gate = gate | F.contains("s", F.lit(f" {g} "))
    n_words = F.when(F.trim("s") == "", 0).otherwise(F.char_length("s") - F.char_length(F.replace("s", F.lit(" "), F.lit(""))) - 1)
    no_words = F.array().cast("array<string>")
    read = rows.select("key", n_words.cast("long").alias("n_words"), F.when(gate, F.split(F.trim("s"), " ")).otherwise(no_words).alias("ws"))
    hits = F.filter(F.transform("ws", lambda w, i: F.when(w.isin(VOCABULARY), F.struct(i.alias("p"), w.alias("w")))), lambda h: h.isNotNull())
    read = read.withColumn("hits", hits).withColumn("seen", F.array_distinct("hits.w"))

    # places of the plain phrases: a phrase's words at consecutive positions of the row's words
    for i, phrase in enumerate(PHRASES):
        read = read.withColumn(f"b{i}", phrase_places(phrase.split()))
    every = F.concat(*[F.col(f"b{i}") for i in range(len(PHRASES))])
    base = F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"b{i}") > 0, F.lit(v)) for i, v in enumerate(PHRASES.values())])))

    # the templates of which all mandatory words occur; the places that the postings of their rarest ones agree on
    alive = F.filter(templates, lambda t: F.forall(t["musts"], lambda m: F.array_contains("seen", m["w"])))
    read = read.withColumn("alive", F.when(F.size("hits") > 0, alive).otherwise(F.array().cast(INDEX)))
    posted = lambda m: F.flatten(F.transform(F.filter("hits", lambda h: h["w"] == m["w"]), lambda h: F.transform(m["ks"], lambda k: h["p"] - k)))
    starts = F.transform("alive", lambda t: F.array_sort(F.flatten(F.transform(F.slice(t["musts"], 1, RARE), posted))))
    read = read.withColumn("starts", starts)
    agreed = lambda o: F.array_distinct(F.filter(o, lambda x, i: (i > 0) & (x == F.get(o, i - 1))))
    stands = lambda x, o: F.coalesce(F.when(o + x["k"] >= 0, F.get("ws", o + x["k"])) == x["w"], F.lit(False))
    verified = F.transform("alive", lambda t, i: F.filter(agreed(F.get("starts", i)), lambda o: F.forall(t["keys"], lambda x: stands(x, o))))
    read = read.withColumn("verified", verified)
    share = lambda t, o: F.round(F.aggregate(t["words"], F.lit(0.0), lambda a, x: a + F.when(stands(x, o), x["idf"]).otherwise(0.0)) / t["full"], 6)
    shares = F.flatten(F.transform("alive", lambda t, i: F.transform(F.get("verified", i), lambda o: share(t, o))))
    found = F.array_compact(F.transform("alive", lambda t, i: F.when(F.size(F.get("verified", i)) > 0, t["label"])))
    out = read.select(
        F.col("key").alias(key), "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        base.alias("base"), found.alias("found"), F.coalesce(F.array_max(shares), F.lit(0.0)).alias("score"),
    )
    return out.select(key, "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", "found")), ",").alias("labels"), "score")


def license_query(docs: DataFrame) -> DataFrame:
    return scan(docs)


def license_sql() -> str:
    """The same in SQL, without index, gates and rare words: every place where all mandatory words of a template stand."""
    template = ", ".join(f"({t}, '{label}', {k}, '{w}', {int(m)})" for t, label, k, w, m in template_words())
    phrases = ", ".join(f"({i}, '{label}', {k}, '{w}', {len(p.split())})" for i, (p, label) in enumerate(PHRASES.items()) for k, w in enumerate(p.split()))
    return f"""
WITH template(t, label, k, w, must) AS (VALUES {template}), phrase(f, label, k, w, size) AS (VALUES {phrases}),
docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
), vocabulary AS (SELECT w FROM template UNION SELECT w FROM phrase),
every AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM docs),
placed AS MATERIALIZED (SELECT r, p, w FROM every SEMI JOIN vocabulary USING (w)),
stands AS (
  SELECT r, f, label, p - k AS o FROM placed JOIN phrase USING (w) GROUP BY r, f, label, size, p - k HAVING count(*) = size
), based AS (
  SELECT r, count(*) AS n_base, min(o) AS first_word, max(o) AS last_word, list_distinct(list(label)) AS base FROM stands GROUP BY r
), idf AS (
  SELECT w, ln(((SELECT count(*) FROM docs) + 1.0) / (count(DISTINCT r) + 1.0)) AS idf FROM placed GROUP BY w
), lookup AS (
  SELECT t, label, k, template.w, must, coalesce(idf, ln(2.0)) AS idf, sum(coalesce(idf, ln(2.0))) OVER (PARTITION BY t) AS full_,
    sum(must) OVER (PARTITION BY t) AS musts FROM template LEFT JOIN idf USING (w)
), votes AS (
  SELECT r, t, p - k AS o FROM placed JOIN (SELECT t, k, w, musts FROM lookup WHERE must = 1) USING (w) GROUP BY r, t, p - k, musts HAVING count(*) = musts
), verified AS (
  SELECT votes.r AS r, t, o, label, sum(idf) / any_value(full_) AS share FROM votes JOIN lookup USING (t) JOIN placed ON placed.r = votes.r AND placed.p = o + k AND placed.w = lookup.w
  GROUP BY votes.r, t, o, label
), found AS (SELECT r, max(round(share, 6)) AS score, list(DISTINCT label) AS labels FROM verified GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(labels, [])))), ',') AS labels, coalesce(score, 0.0) AS score
FROM docs LEFT JOIN based USING (r) LEFT JOIN found USING (r)
"""
