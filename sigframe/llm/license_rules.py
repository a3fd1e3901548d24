"""License scan by ordered signature rules, DataFrame functions only.

Texts are reduced to their words (lower-cased; a word is a run of ASCII letters,
ASCII digits and non-ASCII characters). A keyword test on the text lets few
documents through, a keyword test per rule lets few rules through, and only then
a rule's regular expression runs. Detections are word intervals; one that lies
inside the interval of an earlier rule (smaller priority number, then smaller
rule number) is suppressed.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigframe.llm.common import every_copy, let, one_each

# The phrases whose places are counted, with their labels.
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
# The same words before lower-casing.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Label, regular expression of the name in words, keyword: whatever the expression
# matches holds it, or one of several divided by |.
FAMILIES = (
    ("agpl", r"(?:gnu )?affero general public", "affero"),
    ("agpl", r"(?:gnu )?agpl", "agpl"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public", "general public"),
    ("lgpl", r"(?:gnu )?lgpl", "lgpl"),
    ("gpl", r"(?:gnu )?general public", "general public"),
    ("gpl", r"(?:gnu )?gpl", "gpl"),
    ("gfdl", r"(?:gnu )?free documentation", "free documentation"),
    ("apache", r"apache(?: software)?", "apache"),
    ("mit", r"(?:mit|expat)", " mit| expat"),
    ("mit-0", r"mit (?:no attribution|0)", "mit"),
    ("bsd-2", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", "bsd"),
    ("bsd-3", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)", "bsd"),
    ("bsd-4", r"(?:bsd 4 clause|4 clause bsd|original bsd)", "bsd"),
    ("bsd", r"(?:bsd|berkeley software distribution)", "bsd|berkeley"),
    ("isc", r"(?:isc|internet software consortium)", " isc|internet software"),
    ("mpl", r"(?:mozilla public|mpl)", "mozilla| mpl"),
    ("epl", r"(?:eclipse public|epl)", "eclipse| epl"),
    ("cddl", r"(?:common development and distribution|cddl)", "common development|cddl"),
    ("cpl", r"common public", "common public"),
    ("eupl", r"(?:european union public|eupl)", "european union|eupl"),
    ("artistic", r"artistic", "artistic"),
    ("zlib", r"zlib(?: libpng)?", "zlib"),
    ("boost", r"(?:boost software|bsl 1 0)", "boost|bsl"),
    ("python", r"(?:python software foundation|psf)", "python software|psf"),
    ("unlicense", r"unlicense", "unlicense"),
    ("wtfpl", r"wtfpl", "wtfpl"),
    ("openssl", r"openssl", "openssl"),
    ("ofl", r"(?:sil open font|ofl)", "sil open| ofl"),
    ("ms-pl", r"(?:microsoft public|ms pl)", "microsoft|ms pl"),
    ("ms-rl", r"(?:microsoft reciprocal|ms rl)", "microsoft|ms rl"),
    ("odbl", r"(?:open database|odbl)", "open database|odbl"),
    ("odc-by", r"(?:open data commons attribution|odc by)", "open data|odc by"),
    ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)", "cc by|creative commons"),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", "cc by|creative commons"),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)", "cc by|creative commons"),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)", "cc by|creative commons"),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)", "cc by|creative commons"),
    ("cc-by", r"(?:cc by|creative commons attribution)", "cc by|creative commons"),
    ("cc0", r"(?:cc0|cc 0|creative commons zero)", "cc0|cc 0|creative commons"),
    ("public-domain", r"public domain(?: dedication)?", "public domain"),
)

# How a name is stated, the confidence of that, in order of priority.
# {name}: the family's expression, {ver}: an optional version.
LICENSE = r"(?: public)?(?: licen[sc]e)"
VERSION = r"(?:(?: version| v)?(?: v?\d{1,2}){1,3}|v?\d{1,2}(?: \d{1,2}){0,2})"  # the second is glued to the name
FORMS = (
    (r"spdx licen[sc]e identifier {name}{ver}?(?: or later| only)?", 1.0),
    (r"(?:is |are |be )?licen[sc]ed (?:to you )?under (?:the )?(?:terms of (?:the )?)?{name}{lic}?{ver}?", 0.95),
    (r"(?:released|distributed|published|available|dedicated|placed) (?:under|in|into|to) (?:the )?{name}{lic}?{ver}?", 0.9),
    (r"(?:under the )?terms (?:and conditions )?of (?:the )?{name}{lic}{ver}?", 0.85),
    (r"{name}{lic}{ver}", 0.8),
    (r"{name}{lic}", 0.6),
    (r"licen[sc]e {name}{ver}?", 0.5),
)
# Label, words of the license's own text, keyword. They come before the forms.
BODIES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby"),
    ("mit", r"to permit persons to whom the software is furnished to do so subject to the following conditions", "furnished"),
    ("mit", r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software", "substantial"),
    ("mit-0", r"to permit persons to whom the software is furnished to do so the software is provided as is", "furnished"),
    ("x11", r"except as contained in this notice the names? of(?: the)?(?: [^ ]+){1,4} shall not be used in advertising or otherwise to promote the sale", "advertising"),
    ("isc", r"permission to use copy modify(?: and)?(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that", "hereby"),
    ("0bsd", r"permission to use copy modify(?: and)?(?: or)? distribute this software for any purpose with or without fee is hereby granted the software", "hereby"),
    ("hpnd", r"permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose(?: is hereby granted)? without fee", "documentation"),
    ("bsd-4", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "advertising"),
    ("bsd-3", r"neither the names? of(?: [^ ]+){1,8} nor the names? of(?: [^ ]+){1,4} may be used to endorse or promote products derived", "endorse"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution"),
    ("bsd", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation", "redistributions"),
    ("apache", r"you may not use this file except in compliance with the license", "compliance"),
    ("apache", r"software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", "distributed"),
    ("apache", r"see the license for the specific language governing permissions and limitations under the license", "governing"),
    ("apache", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license", "irrevocable"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", "foundation"),
    ("gpl", r"is free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute"),
    ("gpl", r"you should have received a copy of the gnu general public license(?: along with)?", "have received"),
    ("gpl", r"the licenses for most software(?: and other practical works)? are designed to take away your freedom to share and change", "freedom"),
    ("gpl", r"the gnu general public license is a free copyleft license for software and other kinds of works", "copyleft"),
    ("gpl", r"activities other than copying distribution and modification are not covered by this license they are outside its scope", "activities"),
    ("lgpl", r"(?:is free software )?you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "redistribute"),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license(?: along with)?", "have received"),
    ("lgpl", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3", "incorporates"),
    ("lgpl", r"a program that contains no derivative of any portion of the library but is designed to work with the library", "derivative"),
    ("agpl", r"(?:is free software )?you can redistribute it and or modify it under the terms of the gnu affero general public license", "redistribute"),
    ("agpl", r"you should have received a copy of the gnu affero general public license(?: along with)?", "have received"),
    ("agpl", r"all users interacting with it remotely through a computer network", "remotely"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "documentation"),
    ("gfdl", r"with no invariant sections no front cover texts and no back cover texts", "invariant"),
    ("gpl-exception", r"as a special exception(?: to the gnu (?:lesser )?general public license)?(?: [^ ]+){1,8} (?:give|gives|grant|grants) you(?: additional)? permission to", "exception"),
    ("gpl-exception", r"linking this library statically or dynamically with other modules is making a combined work based on this library", "statically"),
    ("gpl-exception", r"gcc runtime library exception(?: version 3 1)?", "exception"),
    ("gpl-exception", r"permission to link the code of (?:portions of )?this (?:program|library) with the openssl library", "openssl"),
    ("gpl-exception", r"gpl(?: v?[23](?: 0)?)?(?: only| or later)? with (?:classpath|autoconf|bison|font|gcc|linux syscall)(?: [^ ]+){0,2} (?:exception|note)", "gpl"),
    ("apache-exception", r"apache(?: license)?(?: v(?:ersion )?)?(?: ?2 0)? with llvm exceptions?", "llvm"),
    ("mpl", r"this source code form is subject to the terms of the mozilla public license", "mozilla"),
    ("mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at", "mpl"),
    ("mpl", r"the contents of this file are subject to the mozilla public license version 1 [01]", "mozilla"),
    ("mpl", r"this source code form is incompatible with secondary licenses", "incompatible"),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse (?:public|distribution) license", "eclipse"),
    ("epl", r"the accompanying program is provided under the terms of this eclipse public license", "eclipse"),
    ("cpl", r"the accompanying program is provided under the terms of this common public license", "accompanying"),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license", "development"),
    ("cddl", r"when distributing covered (?:code|software) include this cddl header notice in each file", "cddl"),
    ("eupl", r"this european union public licen[cs]e the eupl applies to the work", "eupl"),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied", "intent of this document"),
    ("artistic", r"this license establishes the terms under which a given free software package may be copied modified distributed", "establishes"),
    ("zlib", r"provided as is without any express or implied warranty in no event will the authors be held liable", "liable"),
    ("zlib", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", "misrepresented"),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "misrepresented"),
    ("boost", r"free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "licen"),
    ("python", r"psf hereby grants licensee a nonexclusive royalty free world ?wide license to reproduce", "psf"),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", "openssl"),
    ("openssl", r"this product includes cryptographic software written by(?: [^ ]+){1,3}", "cryptographic"),
    ("ofl", r"permission is hereby granted free of charge to any person obtaining a copy of the font software", "hereby"),
    ("ofl", r"the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects", "ofl"),
    ("ofl", r"no modified version of the font software may use the reserved font names?", "reserved"),
    ("ms-pl", r"a contributor is any person that distributes its contribution under this license licensed patents are a contributor s patent claims", "contributor"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", "compiled"),
    ("wtfpl", r"you just do what the fuck you want to", "fuck"),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed", "verbatim"),
    ("beerware", r"if we meet some day and you think this stuff is worth it you can buy me a beer in return", "this stuff is worth"),
    ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain", "dedicated"),
    ("cc0", r"overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright", "affirmer"),
    ("cc0", r"to the extent possible under law(?: [^ ]+){1,8} (?:has|have) waived all copyright and related or neighbou?ring rights", "waived"),
    ("cc-by", r"you are free to share copy and redistribute the material in any medium or format", "redistribute"),
    ("cc-by", r"you must give appropriate credit provide a link to the license and indicate if changes were made", "appropriate"),
    ("cc-by-sa", r"if you remix transform or build upon the material you must distribute your contributions under the same license as the original", "remix"),
    ("cc-by-nc", r"you may not use the material for commercial purposes", "material for commercial"),
    ("cc-by-nd", r"if you remix transform or build upon the material you may not distribute the modified material", "remix"),
    ("odbl", r"made available under the open database license", "open database"),
    ("odbl", r"any rights in individual contents of the database are licensed under the database contents license", "database contents"),
    ("json", r"the software shall be used for good not evil", "good not evil"),
    ("bsl-1.1", r"use limitation the licensor may make an additional use grant|business source license 1 1", "limitation the licensor|business source"),
    ("sspl", r"server side public license(?: version 1)?", "server side public"),
    ("elastic", r"elastic license(?: v(?:ersion )?)?(?: ?2 0)?", "elastic license"),
    ("dual", r"(?:is |are )?(?:dual|double|triple|multi) licen[sc]ed(?: under)?", "licen"),
    ("dual", r"licen[sc]ed under either of(?: the)?", "licen"),
    ("dual", r"(?:under|of) either the(?: [^ ]+){1,8} licen[sc]e(?: [^ ]+){0,4} or the(?: [^ ]+){1,6} licen[sc]e(?: at your option)?", "licen"),
    ("public-domain", r"(?:has been|is hereby|have been) (?:placed|released|dedicated) (?:in|into|to) the public domain", "domain"),
    ("proprietary", r"unauthori[sz]ed copying of this file via any medium is strictly prohibited", "unauthori"),
    ("proprietary", r"this (?:software|file|source code|document) is (?:the )?(?:confidential and )?proprietary(?: and confidential)?(?: (?:information|property) of)?", "proprietary"),
)
BODY_CONFIDENCE = 0.9
# Label, a name that means a license by itself with a version that it has, keyword.
# Names that are also those of programs or plain words (apache, openssl, zlib, mit) are left out.
_OR = r"(?: or later| only)?"
VERSIONED = (
    ("agpl", r"(?:gnu )?agpl(?: ?v ?| version | )?[13](?: 0)?" + _OR, "agpl"),
    ("lgpl", r"(?:gnu )?lgpl(?: ?v ?| version | )?(?:2 [01]|3 0|[23])" + _OR, "lgpl"),
    ("gpl", r"(?:gnu )?gpl(?: ?v ?| version | )?[123](?: 0)?" + _OR, "gpl"),
    ("mpl", r"mpl(?: ?v ?| version | )?(?:1 [01]|2 0|2)", "mpl"),
    ("epl", r"epl(?: ?v ?| version | )?[12] 0", "epl"),
    ("eupl", r"eupl(?: ?v ?| version | )?1 [012]", "eupl"),
    ("cddl", r"cddl(?: ?v ?| version | )?1 [01]", "cddl"),
    ("ofl", r"ofl(?: ?v ?| version | )?1 [01]", "ofl"),
    ("odbl", r"odbl(?: ?v ?| version | )?1 0", "odbl"),
    *((f"cc-by{x}", f"cc by{x.replace('-', ' ')}(?: ?v ?| version | )?(?:[1-4] 0|2 [15])", "cc by") for x in ("-nc-nd", "-nc-sa", "-nc", "-nd", "-sa", "")),
    ("cc0", r"cc0(?: ?v ?| version | )?1 0", "cc0"),
)
VERSIONED_CONFIDENCE = 0.55
# Most words a detection can have: the longest form around the longest name, the longest body.
MAX_WORDS = 32

# Parts of words, at least one of which stands in most license texts.
STEMS = ("licen", "software", "distribut", "copyright", "permi")


def _gate_words(words: str, keyword: str) -> list[str]:
    """Words of which a text that ``words`` matches holds one: a stem outside all groups, else the
    longest word of each keyword (signs and line ends can stand between words)."""
    bare = words
    while (fewer := re.sub(r"\(\?:[^()]*\)", " ", bare)) != bare:
        bare = fewer
    stem = next((x for x in STEMS if all(x in part for part in bare.split("|"))), None)
    return [stem] if stem else [max(k.split(" "), key=len) for k in keyword.split("|")]


# Texts without any of these hold no base phrase and nothing that a rule finds.
GATE = tuple(dict.fromkeys((
    "licen", "cc", "spdx", "dedicated", "released", "distribut", "published", "available", "placed",
    "gpl", "mpl", "epl", "eupl", "cddl", "ofl", "odbl", *(w for _, words, keyword in BODIES for w in _gate_words(words, keyword)))))


def rules() -> list[dict]:
    """The rules in order: bodies; every form of every family, forms first; names with a
    version; then the base phrases."""
    own = lambda rows, prio, conf: [{"label": label, "kw": keyword, "prio": prio, "conf": conf, "base": False, "re": words} for label, words, keyword in rows]
    out = own(BODIES, 0, BODY_CONFIDENCE)
    out += [{"label": label, "kw": keyword, "prio": prio, "conf": conf, "base": False,
            "re": form.replace("{name}", name).replace("{lic}", LICENSE).replace("{ver}", VERSION)}
           for prio, (form, conf) in enumerate(FORMS, 1) for label, name, keyword in FAMILIES]
    out += own(VERSIONED, len(FORMS) + 1, VERSIONED_CONFIDENCE)
    out += [{"label": label, "kw": phrase, "prio": len(FORMS) + 2, "conf": 0.5, "base": True, "re": phrase} for phrase, label in BASE_PHRASES]
    return [r | {"id": i, "kw": r["kw"].split("|"), "re": f"(?<= )({r['re']})(?= )"} for i, r in enumerate(out)]


GROUP_TYPE = "array<struct<kw:array<string>,rules:array<struct<id:int,label:string,prio:int,conf:double,base:boolean,re:string>>>>"


def _groups() -> list[dict]:
    """Rules by their keywords, each of which is looked up once."""
    out: dict[tuple, list] = {}
    for r in rules():
        out.setdefault(tuple(r["kw"]), []).append({k: v for k, v in r.items() if k != "kw"})
    return [{"kw": list(kw), "rules": own} for kw, own in out.items()]


def _spans(words: Column, rule: Column) -> Column:
    """Word intervals (end exclusive) of a rule's matches: marks go around each match, then
    the marked words are found by their place."""
    marked = F.split(F.regexp_replace(words, rule["re"], F.lit("\u0001$1\u0002")), " ")
    at = lambda test: F.filter(F.transform(marked, lambda w, i: F.when(test(w), i)), lambda i: i.isNotNull())
    found = F.arrays_zip(at(lambda w: w.startswith("\u0001")).alias("s"), at(lambda w: w.endswith("\u0002")).alias("e"))
    return F.when(F.rlike(words, rule["re"]), F.transform(found, lambda x: F.struct(
        (x["s"] - 1).cast("long").alias("start"), x["e"].cast("long").alias("end"), rule["id"].alias("id"), rule["label"].alias("label"),
        rule["prio"].alias("prio"), rule["conf"].alias("conf"), rule["base"].alias("base")))).otherwise(
            F.expr("cast(array() as array<struct<start:bigint,end:bigint,id:int,label:string,prio:int,conf:double,base:boolean>>)"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, base (array of places of the base phrases:
    start, label) and detections (kept ones: start, end, label, rule, confidence), both
    sorted by place. A null text counts as empty: no words, empty arrays. Repeated rows
    each give a row; ids may be null."""
    listed = F.from_json(F.lit(json.dumps(_groups())), GROUP_TYPE)
    low = F.lower("text")
    gate = let(low, lambda t: F.exists(F.array(*[F.lit(k) for k in GATE]), lambda k: F.contains(t, k)))
    joined = F.concat(F.lit(" "), F.trim(F.regexp_replace(low, NOT_WORD + "+", " ")), F.lit(" "))
    spans = F.when(gate, let(joined, lambda w: F.flatten(F.transform(
        F.flatten(F.transform(F.filter(listed, lambda g: F.exists(g["kw"], lambda k: F.contains(w, k))), lambda g: g["rules"])), lambda r: _spans(w, r)))))
    rows = (docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .select("doc_id", F.md5("text").alias("th"), F.regexp_count("text", F.lit(RAW_WORD)).cast("long").alias("n_words"), spans.alias("spans")))
    rows = one_each(rows, "n_words", "spans").select("doc_id", "th", "copies", "n_words", F.explode_outer("spans").alias("s"))
    # A detection's container starts at most MAX_WORDS before it.
    near = Window.partitionBy("doc_id", "th").orderBy("start").rangeBetween(-MAX_WORDS, 0)
    flat = rows.select("doc_id", "th", "copies", "n_words", F.col("s.start").alias("start"), "s")
    around = F.collect_set(F.when(~F.col("s.base"), F.struct("s.end", "s.prio", "s.id", "s.start"))).over(near)
    beaten = F.exists("around", lambda t: (t["end"] >= F.col("s.end")) & (t["start"] <= F.col("s.start")) & (
        (t["prio"] < F.col("s.prio")) | ((t["prio"] == F.col("s.prio")) & (t["id"] < F.col("s.id")))))
    judged = flat.withColumn("around", around).select("doc_id", "th", "copies", "n_words", "s", (~F.col("s.base") & ~beaten).alias("kept"))
    return every_copy(judged.groupBy("doc_id", "th").agg(
        F.first("copies").alias("copies"), F.first("n_words").alias("n_words"),
        F.sort_array(F.collect_list(F.when(F.col("s.base"), F.struct("s.start", "s.label")))).alias("base"),
        F.sort_array(F.collect_list(F.when(F.col("kept"), F.struct(
            "s.start", "s.end", "s.label", F.col("s.id").alias("rule"), F.col("s.conf").alias("confidence"))))).alias("detections"),
    )).drop("th")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from those of ``scan``."""
    labels = lambda c: F.transform(c, lambda x: x["label"])
    join = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["start"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["start"])).alias("last_word"),
        join(labels("base")).alias("base_labels"), join(F.concat(labels("base"), labels("detections"))).alias("labels"),
        F.coalesce(F.array_max(F.concat(F.transform("detections", lambda x: x["confidence"]), F.transform("base", lambda x: F.lit(0.5)))), F.lit(0.0)).alias("score"),
        F.transform("detections", lambda x: F.concat_ws(":", x["label"], x["start"].cast("string"), x["end"].cast("string"))).alias("detections"))
