r"""License scans by an exact set-similarity join, in DataFrame functions only.

Templates are token sets, each with the share of its tokens that a text block must hold (containment). Blocks are
64 words long and start every 32 words, so any 33 consecutive words lie whole in one block; longer templates, whole
license texts, have blocks of twice the length until they fit in the same way. The tokens of all templates are ordered
by their frequency over the whole table, rarest first, and each block is the sorted list of its template tokens.

A block that holds ``need`` of a template's ``n`` tokens must hold one of its ``n - need + 1`` rarest. An index of these
prefixes is joined with the tokens of the blocks, and only what meets there is a candidate (prefix filter). A candidate
block must have ``need`` tokens and words (length filter), and from its first common token on both sides must have
``need`` tokens left (positional filter). Only then is the overlap counted in full. Templates marked as phrases are
confirmed by their words standing consecutively, which gives their places.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z in lower case.

Defined cases: null text has no words; a text without any word has none either; repeated rows, and rows with the same
or a null id, are kept apart; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Words from the start of a block to the next one's for the shortest templates; a block is twice as long.
STRIDE = 32


@dataclass(frozen=True)
class Template:
    """A label, its words, the containment that counts, and whether the words must stand consecutively."""

    label: str
    words: str
    share: float = 1.0
    phrase: bool = True
    base: bool = False

    @property
    def tokens(self) -> list[str]:
        return sorted(set(self.words.split()))

    @property
    def need(self) -> int:
        """Tokens that a block must hold."""
        return max(1, ceil(self.share * len(self.tokens) - 1e-9))

    @property
    def stride(self) -> int:
        """The least stride by which any place of all the words lies whole in one block."""
        out = STRIDE
        while out + 1 < len(self.words.split()):
            out *= 2
        return out


#: The words of license texts and notices.
MIT_TEXT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the "
    "software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
    "and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice "
    "shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied "
    "including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright "
    "holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the "
    "software or the use or other dealings in the software"
)
BSD_TEXT = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of "
    "source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above "
    "copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software "
    "is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect "
    "incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or "
    "business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in "
    "any way out of the use of this software even if advised of the possibility of such damage"
)
ISC_TEXT = (
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and "
    "this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all "
    "implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages "
    "whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with "
    "the use or performance of this software"
)
ZLIB_TEXT = (
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this "
    "software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely "
    "subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use "
    "this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly "
    "marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution"
)
APACHE_HEADER = (
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
    "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as "
    "is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations "
    "under the license"
)
GPL_HEADER = (
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
    "foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any "
    "warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"
)

#: The base phrases, then the method's own.
TEMPLATES = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
    Template("agpl", "gnu affero general public license"),
    Template("lgpl", "gnu lesser general public license"),
    Template("mpl", "mozilla public license"),
    Template("epl", "eclipse public license"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-sa", "cc by sa"),
    Template("all-rights-reserved", "all rights reserved"),
    Template("apache-notice", "licensed under the apache license version 2 0", 0.85, False),
    Template("gpl-notice", "this work is licensed under the gnu general public license version 3", 0.85, False),
    Template("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted", 0.8, False),
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software", 0.8, False),
    Template("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.8, False),
    Template("unlicense", "this is free and unencumbered software released into the public domain", 0.8, False),
    Template("mit-text", MIT_TEXT, 0.8, False),
    Template("bsd-text", BSD_TEXT, 0.8, False),
    Template("isc-text", ISC_TEXT, 0.8, False),
    Template("zlib-text", ZLIB_TEXT, 0.8, False),
    Template("apache-header", APACHE_HEADER, 0.8, False),
    Template("gpl-header", GPL_HEADER, 0.8, False),
)

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower_ascii(text: Column) -> Column:
    """Lower case by the JVM's fast path; the two characters beyond ASCII that would become ASCII ones are swapped first
    for letters that stay. Only ASCII words are compared, so the case of other letters does not matter."""
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u0138")), F.lit("\u0130"), F.lit("\u0131")))


def words_of(text: Column) -> Column:
    """All words, with an empty one before the first or after the last where the text starts or ends between words."""
    return F.split(_lower_ascii(F.coalesce(text, F.lit(""))), _SEPARATORS)


def _values(df: DataFrame, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A local relation (no job, no Python): rows of strings and numbers."""
    names = [p.split()[0] for p in schema.split(",")]
    body = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).lower() for v in r) + ")" for r in rows)
    return df.sparkSession.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")


def blocks_of(tokens: DataFrame, templates: tuple[Template, ...], order: dict[str, int]) -> DataFrame:
    """``rid, stride, block, words, tokens``: the sorted places in ``order`` of each block's template tokens, and its length."""
    strides = _values(tokens, sorted({(w, t.stride, order[w]) for t in templates for w in t.tokens}), "tok,stride,place")  # as long as the templates
    last = (F.col("pos") / F.col("stride")).cast("long")
    each = tokens.join(F.broadcast(strides), "tok").withColumn("block", F.explode(F.array_compact(F.array(last, F.when(last > 0, last - 1)))))
    words = F.least(F.col("n_words") - F.col("block") * F.col("stride"), 2 * F.col("stride"))
    return each.groupBy("rid", "stride", "block", words.alias("words")).agg(F.array_sort(F.collect_set("place")).alias("tokens"))


def candidates(blocks: DataFrame, templates: tuple[Template, ...], order: dict[str, int]) -> DataFrame:
    """Blocks and templates that share a prefix token, with what the other filters ask: ``tid, need`` and ``left``, the
    tokens that the template and the block both have from their first common prefix token on."""
    index = []
    for tid, t in enumerate(templates):
        own = sorted(order[w] for w in t.tokens)
        index += [(tid, t.stride, place, rank, len(own), t.need) for rank, place in enumerate(own[: len(own) - t.need + 1])]
    prefixes = _values(blocks, index, "tid,stride,place,rank,n,need")  # as long as the templates
    met = blocks.select("rid", "stride", "block", "words", "tokens", F.posexplode("tokens").alias("at", "place")).join(F.broadcast(prefixes), ["stride", "place"])
    first = met.groupBy("rid", "stride", "block", "words", "tokens", "tid", "n", "need").agg(F.min(F.struct("rank", "at")).alias("first"))
    return first.withColumn("left", F.least(F.col("n") - F.col("first.rank"), F.size("tokens") - F.col("first.at")))


def long_enough(found: DataFrame) -> DataFrame:
    """The length filter."""
    return found.where((F.size("tokens") >= F.col("need")) & (F.col("words") >= F.col("need")))


def contained(blocks: DataFrame, templates: tuple[Template, ...], order: dict[str, int]) -> DataFrame:
    """``rid, tid, share`` of every block and template that meet the template's share."""
    sets = _values(blocks, [(tid, ",".join(str(order[w]) for w in t.tokens)) for tid, t in enumerate(templates)], "tid,members")
    sets = sets.select("tid", F.split("members", ",").cast("array<int>").alias("members"))  # a row a template
    found = long_enough(candidates(blocks, templates, order)).where(F.col("left") >= F.col("need"))
    found = found.join(F.broadcast(sets), "tid").withColumn("overlap", F.size(F.array_intersect("tokens", "members")))
    return found.where(F.col("overlap") >= F.col("need")).select("rid", "tid", (F.col("overlap") / F.col("n")).alias("share"))


def frequency_order(words: DataFrame, templates: tuple[Template, ...]) -> dict[str, int]:
    """The templates' tokens from the rarest to the most frequent of the whole table (``w``: arrays of words)."""
    vocabulary = sorted({w for t in templates for w in t.tokens})
    counts = words.select(F.explode("w").alias("tok")).where(F.col("tok").isin(vocabulary)).groupBy("tok").count()
    frequency = {r["tok"]: r["count"] for r in counts.collect()}  # as many numbers as the templates have tokens
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}


def scan(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row."""
    split = df.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("w"))
    order = frequency_order(split, templates)
    prefixes = sorted({w for t in templates for w in sorted(t.tokens, key=order.__getitem__)[: len(t.tokens) - t.need + 1]})

    # One pass over the texts: word counts of all rows; template tokens and places only of rows with a prefix token.
    empty_first, empty_last = (F.element_at("w", k) == "" for k in (1, -1))
    rows = split.select(
        "id",
        F.monotonically_increasing_id().alias("rid"),
        (F.size("w") - empty_first.cast("int") - (empty_last & (F.size("w") > 1)).cast("int")).cast("long").alias("n_words"),
        F.when(
            F.arrays_overlap("w", F.array(*map(F.lit, prefixes))),
            F.filter(F.transform("w", lambda w, i: F.struct((i - (F.col("w")[0] == "").cast("int")).cast("long").alias("pos"), w.alias("tok"))), lambda x: x["tok"].isin(list(order))),
        ).alias("toks"),
    )
    rows = written(rows, "license-words")  # the row numbers are fixed from here on

    tokens = rows.where("toks is not null").select("rid", "n_words", F.inline("toks"))
    found = contained(blocks_of(tokens, templates, order), templates, order).groupBy("rid", "tid").agg(F.max("share").alias("share"))
    found = found.join(F.broadcast(_values(df, [(tid, t.phrase) for tid, t in enumerate(templates)], "tid,phrase")), "tid")

    places = [(tid, w, k, len(t.words.split())) for tid, t in enumerate(templates) if t.phrase for k, w in enumerate(t.words.split())]
    steps = _values(df, places, "tid,tok,k,size")
    starts = tokens.join(F.broadcast(steps), "tok").join(found.where("phrase").select("rid", "tid"), ["rid", "tid"], "left_semi")
    starts = starts.groupBy("rid", "tid", "size", (F.col("pos") - F.col("k")).alias("start")).agg(F.count("*").alias("hit")).where(F.col("hit") == F.col("size"))
    names = _values(df, [(tid, t.label, t.base) for tid, t in enumerate(templates)], "tid,label,base")
    confirmed = starts.groupBy("rid", "tid").agg(F.count("*").alias("n_places"), F.min("start").alias("first_place"), F.max("start").alias("last_place")).withColumn("share", F.lit(1.0))
    loose = found.where(~F.col("phrase")).select("rid", "tid", F.lit(0).cast("long").alias("n_places"), F.lit(None).cast("long").alias("first_place"), F.lit(None).cast("long").alias("last_place"), "share")
    hits = confirmed.unionByName(loose).join(F.broadcast(names), "tid")
    of_base = F.col("base")
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per_row = hits.groupBy("rid").agg(
        F.sum(F.when(of_base, F.col("n_places"))).alias("n_base"),
        F.min(F.when(of_base, F.col("first_place"))).alias("first_word"),
        F.max(F.when(of_base, F.col("last_place"))).alias("last_word"),
        labels(F.when(of_base, F.col("label"))).alias("base_labels"),
        labels(F.col("label")).alias("labels"),
        F.max("share").alias("score"),
    )
    out = rows.select("rid", "id", "n_words").join(per_row, "rid", "left")
    none = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return out.select(F.col("id").alias(id_col), "n_words", *(F.coalesce(c, none[c]).alias(c) if c in none else F.col(c) for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")))
