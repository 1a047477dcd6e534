"""Licence recognition by sentences, in DataFrame functions alone.

A text is cut into blocks, at blank lines and where a line ends with a sentence mark, and a block into sentences in three
ways: with lines joined (for wrapped notices), with lines joined but before one that begins with a capital, and line by line.
A sentence that names another licence after an operator of an expression, or after "or the", is cut there too. Each
sentence is normalised (lower case, words only) and mapped to the identifier of a known licence sentence. Of a block's
readings the one with the most identifiers counts; of equal ones the most precise, whose identifiers come first in SENTENCES,
then the first named here. The identifiers of a text's blocks, in order, are matched against ordered rules; each rule that
matches names a licence and uses its identifiers up. All of it happens within the row:
no shuffle, and memory in proportion to one text. Texts that hold no cue, with any blanks or marks between its words, are not cut up; as every known sentence holds one, none is lost (the query's SQL does without this).

Edge cases: a text that is null or empty, or has no known sentence, has no row; a sentence with a cue that is not known
counts as unknown; identifiers that no rule takes stand alone as ``UnmatchedSentence``; of sentences that fit several
patterns the first counts; repeated rows and null ids each give a row; texts of any length are read whole; an empty table
gives an empty result; other columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

# Words one of which every known sentence holds. A sentence with one of the first is unknown if no pattern fits.
CUES = "licen[cs]e|copyright|permission|warrant|redistribut|rights reserved|public domain|liable|copyleft"
OTHER_CUES = r"may not use this file|as is|endorse or promote|copy of the license|creative commons|cc0|gpl|cc by|wtfpl|unencumbered|misrepresented|altered source|confidential|commercial use|commercial purposes"
# Parts of words, one of which every text with such a sentence holds.
PARTS = ["licen", "copyright", "permission", "warrant", "redistribut", "reserved", "domain", "liable", "copyleft", "provided", "endorse", "commons", "cc", "gpl", "wtfpl", "unencumbered", "misrepresented", "altered", "confidential", "commercial"]

# Known licence sentences as patterns on the normalised sentence, the first match counts.
SENTENCES = [
    ("AGPL3", r"gnu affero general public licen[cs]e.*version 3|\bagpl ?v?3"),
    ("AGPL", r"gnu affero general public licen[cs]e"),
    ("GPL3+", r"gnu general public licen[cs]e.*version 3.*(any|or) later|identifier gpl 3 0 or later"),
    ("GPL2+", r"gnu general public licen[cs]e.*version 2.*(any|or) later|identifier gpl 2 0 or later"),
    ("LGPL3", r"gnu (lesser|library) general public licen[cs]e.*version 3|\blgpl ?v?3"),
    ("LGPL2.1", r"gnu (lesser|library) general public licen[cs]e.*version 2 1|\blgpl ?v?2 1"),
    ("LGPL", r"gnu (lesser|library) general public licen[cs]e|\blgpl\b"),
    ("GFDL", r"gnu free documentation licen[cs]e|identifier gfdl"),
    ("GPL3", r"gnu general public licen[cs]e.*version 3|licensed under (the )?gpl ?v?3\b|identifier gpl 3 0"),
    ("GPL2", r"gnu general public licen[cs]e.*version 2|licensed under (the )?gpl ?v?2\b|identifier gpl 2 0"),
    ("GPL", r"gnu general public licen[cs]e|licensed under (the )?gpl\b"),
    ("Apache1.1", r"apache (software )?licen[cs]e version 1 1|identifier apache 1 1"),
    ("Apache2", r"apache licen[cs]e version 2( 0)?|apache licen[cs]e 2 0|identifier apache 2 0|licen[cs]ed? (under )?(the )?apache 2( 0)?\b"),
    ("Apache2Limit", r"you may not use this file except in compliance with the licen[cs]e"),
    ("Apache2Copy", r"you may obtain a copy of the licen[cs]e at"),
    ("Apache2AsIs", r"distributed under the licen[cs]e is distributed on an as is basis"),
    ("MITperm", r"^permission is hereby granted free of charge to any person obtaining a copy"),
    ("MITnotice", r"the above copyright notice and this permission notice shall be included"),
    ("MITref", r"(licensed|released|distributed|available) under (the )?(terms of the )?mit( licen[cs]e)?\b|^(the )?mit licen[cs]e$|^licen[cs]e mit$|identifier mit\b"),
    ("Zlibuse", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("Zliborigin", r"the origin of this software must not be misrepresented"),
    ("Zlibaltered", r"altered source versions must be plainly marked"),
    ("Zlibnotice", r"this notice may not be removed or altered from any source distribution"),
    ("Zlibref", r"(licensed|released|distributed|available) under (the )?(terms of the )?zlib licen[cs]e|identifier zlib\b"),
    ("BSDredist", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("BSDsource", r"redistributions of source code must retain the above copyright notice"),
    ("BSDbinary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BSDadvert", r"all advertising materials mentioning features or use of this software must display"),
    ("BSDendorse", r"may be used to endorse or promote products derived"),
    ("BSD3ref", r"bsd 3 clause|3 clause bsd|new bsd licen[cs]e|revised bsd licen[cs]e"),
    ("BSD2ref", r"bsd 2 clause|2 clause bsd|simplified bsd licen[cs]e|freebsd licen[cs]e"),
    ("BSDref", r"(licensed|released|distributed|available) under (the )?(terms of the )?([a-z0-9]+ )?bsd( [a-z0-9]+)? licen[cs]e|^(the )?bsd licen[cs]e$"),
    ("MPL1.1", r"mozilla public licen[cs]e (v|version) ?1 1|identifier mpl 1 1"),
    ("MPL2", r"mozilla public licen[cs]e.*(v|version) ?2|identifier mpl 2 0"),
    ("EPL2", r"eclipse public licen[cs]e (v|version )? ?2|identifier epl 2 0"),
    ("EPL1", r"eclipse public licen[cs]e (v|version )? ?1|identifier epl 1 0"),
    ("EPL", r"eclipse public licen[cs]e"),
    ("EUPL", r"european union public licen[cs]e|identifier eupl"),
    ("CDDL", r"common development and distribution licen[cs]e|identifier cddl"),
    ("OSL", r"open software licen[cs]e|identifier osl"),
    ("AFL", r"academic free licen[cs]e|identifier afl"),
    ("MSPL", r"microsoft public licen[cs]e|identifier ms pl"),
    ("MSRL", r"microsoft reciprocal licen[cs]e|identifier ms rl"),
    ("ISC", r"permission to use copy modify and or distribute this software for any purpose|(licensed|released|distributed|available) under (the )?(terms of the )?isc licen[cs]e|identifier isc\b"),
    ("Boostperm", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("Boostref", r"boost software licen[cs]e|identifier bsl 1 0"),
    ("Artistic2", r"artistic licen[cs]e 2 0|artistic licen[cs]e version 2|identifier artistic 2 0"),
    ("Artistic", r"artistic licen[cs]e"),
    ("OFL", r"(sil )?open font licen[cs]e|identifier ofl"),
    ("ODbL", r"open database licen[cs]e|identifier odbl"),
    ("ODCBY", r"open data commons attribution licen[cs]e|identifier odc by"),
    ("PDDL", r"public domain dedication and licen[cs]e|identifier pddl"),
    ("PSF", r"python software foundation licen[cs]e|psf licen[cs]e agreement|identifier psf|identifier python 2"),
    ("PostgreSQL", r"postgresql licen[cs]e|identifier postgresql"),
    ("NCSA", r"university of illinois ncsa open source licen[cs]e|identifier ncsa"),
    ("PHP", r"php licen[cs]e|identifier php"),
    ("Ruby", r"ruby licen[cs]e|identifier ruby"),
    ("WTFPL", r"do what the f[a-z]* you want to public licen[cs]e|\bwtfpl"),
    ("Unlicense", r"free and unencumbered software released into the public domain|\bunlicense\b"),
    ("CC0", r"creative commons (zero|cc0)|cc0 1 0|^licensed under cc0|cc0 public domain"),
    ("CCBYNCSA", r"creative commons attribution non ?commercial share ?alike|cc by nc sa"),
    ("CCBYNCND", r"creative commons attribution non ?commercial no ?deriv|cc by nc nd"),
    ("CCBYNC", r"creative commons attribution non ?commercial|cc by nc"),
    ("CCBYSA", r"creative commons attribution share ?alike|cc by sa"),
    ("CCBYND", r"creative commons attribution no ?deriv|cc by nd"),
    ("CCBY", r"creative commons attribution|cc by\b"),
    ("CC", r"creative commons licen[cs]e"),
    ("PublicDomain", r"(in|into|to) the public domain"),
    ("NonCommercial", r"for non ?commercial (use|purposes)( only)?|no commercial use"),
    ("Proprietary", r"proprietary and confidential|confidential and proprietary|unauthori[sz]ed (copying|use|distribution).*prohibited"),
    ("AsIs", r"provided (by .*)?as is (and|without)|is provided as is"),
    ("NoLiability", r"in no event (shall|will) .*be (held )?liable"),
    ("WarrantyGPL", r"without any warranty without even the implied warranty"),
    ("GPLcopy", r"you should have received a copy of the gnu .*licen[cs]e"),
    ("AllRights", r"^(copyright .*)?all rights reserved( .*)?$"),
    ("CopyrightLine", r"^(portions )?copyright (c )?([0-9]{4}|by )"),
]

# Ordered rules over the sequence of identifiers, each in angle brackets.
RULES = [
    ("Apache-2.0", r"<Apache2>(?:<Apache2Limit>)?(?:<Apache2Copy>)?(?:<Apache2AsIs>)?"),
    ("Apache-2.0", r"<Apache2Limit>(?:<Apache2Copy>)?(?:<Apache2AsIs>)?"),
    ("Apache-1.1", r"<Apache1\.1>"),
    ("MIT", r"(?:<MITref>)?<MITperm>(?:<MITnotice>)?(?:<AsIs>)?(?:<NoLiability>)?"),
    ("MIT", r"<MITref>"),
    ("BSL-1.0", r"(?:<Boostref>)?<Boostperm>(?:<AsIs>)?(?:<NoLiability>)?"),
    ("BSL-1.0", r"<Boostref>"),
    ("Zlib", r"(?:<AsIs>)?(?:<NoLiability>)?<Zlibuse>(?:<Zliborigin>)?(?:<Zlibaltered>)?(?:<Zlibnotice>)?"),
    ("Zlib", r"<Zlibref>"),
    ("BSD-4-Clause", r"<BSDredist><BSDsource><BSDbinary><BSDadvert>(?:<BSDendorse>)?(?:<AsIs>)?(?:<NoLiability>)?"),
    ("BSD-3-Clause", r"(?:<BSD3ref>)?<BSDredist><BSDsource><BSDbinary>(?:<[A-Za-z]*>)?<BSDendorse>(?:<AsIs>)?(?:<NoLiability>)?"),
    ("BSD-2-Clause", r"(?:<BSD2ref>)?<BSDredist><BSDsource><BSDbinary>(?:<AsIs>)?(?:<NoLiability>)?"),
    ("BSD-3-Clause", r"<BSD3ref>"),
    ("BSD-2-Clause", r"<BSD2ref>"),
    ("BSD", r"<BSDref>"),
    ("AGPL-3.0", r"<AGPL3>(?:<WarrantyGPL>)?(?:<GPLcopy>)?"),
    ("AGPL", r"<AGPL>(?:<WarrantyGPL>)?(?:<GPLcopy>)?"),
    ("LGPL-3.0", r"<LGPL3>(?:<WarrantyGPL>)?(?:<GPLcopy>)?"),
    ("LGPL-2.1", r"<LGPL2\.1>(?:<WarrantyGPL>)?(?:<GPLcopy>)?"),
    ("LGPL", r"<LGPL>(?:<WarrantyGPL>)?(?:<GPLcopy>)?"),
    ("GPL-3.0-or-later", r"<GPL3\+>(?:<WarrantyGPL>)?(?:<GPL>)?(?:<GPLcopy>)?"),
    ("GPL-2.0-or-later", r"<GPL2\+>(?:<WarrantyGPL>)?(?:<GPL>)?(?:<GPLcopy>)?"),
    ("GPL-3.0", r"<GPL3>(?:<WarrantyGPL>)?(?:<GPL>)?(?:<GPLcopy>)?"),
    ("GPL-2.0", r"<GPL2>(?:<WarrantyGPL>)?(?:<GPL>)?(?:<GPLcopy>)?"),
    ("GPL", r"<GPL>(?:<WarrantyGPL>)?(?:<GPLcopy>)?"),
    ("GFDL", r"<GFDL>"),
    ("MPL-1.1", r"<MPL1\.1>"),
    ("MPL-2.0", r"<MPL2>"),
    ("EPL-1.0", r"<EPL1>"),
    ("EPL-2.0", r"<EPL2>"),
    ("EPL", r"<EPL>"),
    ("EUPL", r"<EUPL>"),
    ("CDDL", r"<CDDL>"),
    ("OSL", r"<OSL>"),
    ("AFL", r"<AFL>"),
    ("MS-PL", r"<MSPL>"),
    ("MS-RL", r"<MSRL>"),
    ("ISC", r"<ISC>(?:<AsIs>)?(?:<NoLiability>)?"),
    ("Artistic-2.0", r"<Artistic2>"),
    ("Artistic", r"<Artistic>"),
    ("OFL", r"<OFL>"),
    ("ODbL", r"<ODbL>"),
    ("ODC-By", r"<ODCBY>"),
    ("PDDL", r"<PDDL>"),
    ("PSF", r"<PSF>"),
    ("PostgreSQL", r"<PostgreSQL>"),
    ("NCSA", r"<NCSA>"),
    ("PHP", r"<PHP>"),
    ("Ruby", r"<Ruby>"),
    ("WTFPL", r"<WTFPL>"),
    ("Unlicense", r"<Unlicense>"),
    ("CC0-1.0", r"<CC0>"),
    ("CC-BY-NC-SA", r"<CCBYNCSA>"),
    ("CC-BY-NC-ND", r"<CCBYNCND>"),
    ("CC-BY-NC", r"<CCBYNC>"),
    ("CC-BY-SA", r"<CCBYSA>"),
    ("CC-BY-ND", r"<CCBYND>"),
    ("CC-BY", r"<CCBY>"),
    ("CC", r"<CC>"),
    ("PublicDomain", r"<PublicDomain>"),
    ("NonCommercial", r"<NonCommercial>"),
    ("Proprietary", r"<Proprietary>"),
    ("AllRightsReserved", r"<AllRights>"),
]
#: Identifiers that name no licence by themselves.
NEUTRAL = ("CopyrightLine", "AsIs", "NoLiability", "WarrantyGPL")
UNKNOWN = "?"


def _gate() -> str:
    """The cues as they may stand in a text: any blanks and marks between words."""
    return (CUES + "|" + OTHER_CUES).replace(r"\b", "(?:^|[^a-z0-9])").replace(" ", "[^a-z0-9]+")


def _may_hold(text: Column) -> Column:
    """Whether a text may hold a cue: a cheap test for parts of words, and for texts that pass it the cues themselves."""
    held = lambda t: reduce(or_, (F.contains(t, F.lit(x)) for x in PARTS)) & t.rlike(_gate())
    return F.exists(F.array(F.lower(text)), held)


def _identify(sentence: Column) -> Column:
    """The identifier of a sentence, UNKNOWN if it has a cue only, else null."""
    norm = F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))
    chain = F.when(~norm.rlike(CUES + "|" + OTHER_CUES), None)
    for name, pattern in SENTENCES:
        chain = chain.when(norm.rlike(pattern), name)
    return chain.when(norm.rlike(CUES), UNKNOWN)


#: Where a sentence goes on with another licence, and what stands before that one as a sentence of its own: an operator of an
#: expression before an identifier, or a licence after "or the".
ALTERNATIVES = [
    ("License-Identifier ", r"[ \t]+(?:OR|AND)[ \t]+\(?(MIT|ISC|Zlib|Unlicense|[A-Za-z]+-[A-Za-z.-]*[0-9][A-Za-z0-9.-]*)"),
    ("", r"[ \t]+(?:or|and|and/or)[ \t]+(?:under[ \t]+)?the[ \t]+([A-Z][A-Za-z0-9.() \t-]{0,60}?[Ll]icen[cs]e)"),
]


#: Sentence marks within one known sentence, and what stands for them.
WITHIN = [(r";([ \t\n*#/]*)(either|without)", r",$1$2")]
#: Where a block ends: after a line that ends with a sentence mark, and at a blank line (marks of comments aside).
BLOCK_ENDS = [(r"([.!?:;][\"')]*)[ \t]*\n", "$1\x01"), (r"\n[ \t*#/]*\n", "\x01")]
#: The readings of a block: which line breaks within it become blanks.
READINGS = [(r"[ \t]*\n[ \t]*", " "), (r"[ \t]*\n([ \t*#/;-]*[a-z0-9(\"'])", " $1"), None]
NAMES = [n for n, _ in SENTENCES]


def _ids(text: Column) -> Column:
    named = F.regexp_replace(text, "([Ii]dentifier|[Ll]icen[cs]e)[ \\t]*:[ \\t]*", "$1 ")
    for lead, pattern in ALTERNATIVES:
        named = F.regexp_replace(named, pattern, "\n" + lead + "$1")
    sentences = F.split(F.regexp_replace(named, "([.!?:;])[ \\t]+", "$1\n"), "\n+")
    return F.filter(F.transform(sentences, _identify), lambda x: x.isNotNull())


def _read(text: Column) -> Column:
    """The identifiers of a text: of each block those of the reading that counts."""
    names = F.array(*map(F.lit, NAMES))
    known = lambda ids: F.filter(ids, lambda x: x != UNKNOWN)
    late = lambda ids: F.aggregate(known(ids), F.lit(0), lambda acc, x: acc + F.array_position(names, x).cast("int"))
    read = lambda block: F.array(*(_ids(F.regexp_replace(block, *r) if r else block) for r in READINGS))
    graded = lambda block: F.transform(read(block), lambda ids, i: F.struct(F.size(known(ids)).alias("n"), (-late(ids)).alias("early"), (-i).alias("place"), ids.alias("ids")))
    for pattern, new in WITHIN + BLOCK_ENDS:
        text = F.regexp_replace(text, pattern, new)
    return F.flatten(F.transform(F.split(text, "\x01"), lambda block: F.array_max(graded(block))["ids"]))


def recognise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, licenses (names in order of the rules, joined), sentence_ids, n_sentences, n_unknown."""
    cued = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")).filter(_may_hold(F.col("_t")))
    read = cued.select("doc_id", _read(F.col("_t")).alias("all"))
    read = read.select("doc_id", "all", F.filter("all", lambda x: x != UNKNOWN).alias("ids")).filter(F.size("ids") > 0)
    rules = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(p).alias("rule")) for n, p in RULES))
    start = F.struct(F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "").alias("left"), F.array().cast("array<string>").alias("found"))
    step = lambda s, r: F.struct(
        F.regexp_replace(s["left"], r["rule"], F.lit("")).alias("left"),
        F.when(F.regexp_like(s["left"], r["rule"]), F.array_union(s["found"], F.array(r["name"]))).otherwise(s["found"]).alias("found"),
    )
    read = read.withColumn("m", F.aggregate(rules, start, step))
    rest = F.filter(F.split("m.left", "[<>]+"), lambda x: (x != "") & ~x.isin(*NEUTRAL))
    names = F.when(F.size(rest) > 0, F.array_union("m.found", F.array(F.lit("UnmatchedSentence")))).otherwise(F.col("m.found"))
    return read.select(
        "doc_id",
        F.array_join(names, ",").alias("licenses"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.size("ids").cast("long").alias("n_sentences"),
        (F.size("all") - F.size("ids")).cast("long").alias("n_unknown"),
    )


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    return recognise(documents(spark, sf_dir))


def oracle_sql() -> str:
    """The same recognition in DuckDB's SQL."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    norm = "trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))"
    chain = f"CASE WHEN NOT regexp_matches(n, {q(CUES + '|' + OTHER_CUES)}) THEN NULL " + " ".join(f"WHEN regexp_matches(n, {q(p)}) THEN {q(k)}" for k, p in SENTENCES) + f" WHEN regexp_matches(n, {q(CUES)}) THEN '{UNKNOWN}' END"

    def read(text):
        named = f"regexp_replace({text}, '([Ii]dentifier|[Ll]icen[cs]e)[ \\t]*:[ \\t]*', '\\1 ', 'g')"
        for lead, pattern in ALTERNATIVES:
            named = f"regexp_replace({named}, {q(pattern)}, chr(10) || '{lead}\\1', 'g')"
        parts = f"string_split(regexp_replace({named}, '([.!?:;])[ \\t]+', '\\1' || chr(10), 'g'), chr(10))"
        return f"list_filter(list_transform(list_transform({parts}, lambda s: {norm}), lambda n: {chain}), lambda x: x IS NOT NULL)"

    def swapped(text, pattern, new):
        new = " || ".join(f"chr({ord(x)})" if x < " " else q(x) for x in re.split("([\x00-\x1f])", new.replace("$", "\\")) if x)
        return f"regexp_replace({text}, {q(pattern)}, {new}, 'g')"

    text = "text"
    for rule in WITHIN + BLOCK_ENDS:
        text = swapped(text, *rule)
    names = "[" + ", ".join(map(q, NAMES)) + "]"
    readings = " UNION ALL ".join(f"SELECT i, b, {-k} AS place, {read(swapped('block', *r) if r else 'block')} AS ids FROM b" for k, r in enumerate(READINGS))
    out = "WITH c AS (SELECT row_number() OVER () AS i, doc_id, text FROM documents), "
    out += f"l AS (SELECT i, string_split({text}, chr(1)) AS blocks FROM c), b AS (SELECT i, unnest(blocks) AS block, generate_subscripts(blocks, 1) AS b FROM l), "
    out += f"k AS ({readings}), g AS (SELECT *, list_filter(ids, lambda x: x <> '{UNKNOWN}') AS known FROM k WHERE len(ids) > 0), "
    out += f"o AS (SELECT i, b, place, ids, len(known) AS n, -coalesce(list_sum(list_transform(known, lambda x: list_position({names}, x))), 0) AS early FROM g), "
    out += "w AS (SELECT i, b, ids FROM o QUALIFY row_number() OVER (PARTITION BY i, b ORDER BY n DESC, early DESC, place DESC) = 1), "
    out += "x AS (SELECT i, doc_id, flatten(list(ids ORDER BY b)) AS every FROM w JOIN c USING (i) GROUP BY i, doc_id), "
    out += f"y AS (SELECT *, list_filter(every, lambda x: x <> '{UNKNOWN}') AS ids FROM x), "
    out += "m0 AS (SELECT *, array_to_string(list_transform(ids, lambda x: '<' || x || '>'), '') AS rest, CAST([] AS VARCHAR[]) AS found FROM y WHERE len(ids) > 0)"
    for k, (name, rule) in enumerate(RULES):
        add = f"CASE WHEN regexp_matches(rest, {q(rule)}) AND NOT list_contains(found, {q(name)}) THEN list_append(found, {q(name)}) ELSE found END"
        out += f", m{k + 1} AS (SELECT i, doc_id, every, ids, regexp_replace(rest, {q(rule)}, '', 'g') AS rest, {add} AS found FROM m{k})"
    neutral = ", ".join(map(q, ("", *NEUTRAL)))
    left = f"len(list_filter(string_split(replace(rest, '<', ''), '>'), lambda x: x NOT IN ({neutral})))"
    return out + (
        f" SELECT doc_id, array_to_string(CASE WHEN {left} > 0 THEN list_append(found, 'UnmatchedSentence') ELSE found END, ',') AS licenses, array_to_string(ids, ',') AS sentence_ids, "
        f"CAST(len(ids) AS BIGINT) AS n_sentences, CAST(len(every) - len(ids) AS BIGINT) AS n_unknown FROM m{len(RULES)}"
    )
