"""Licence scans: canonical texts meet the digests of known licences in a hash join."""

import csv
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, chain
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.common import letters

# Equivalent spellings of the public licence matching guidelines, first form to second.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment",
    "https": "http", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license",
    "licences": "licenses", "licenced": "licensed", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling",
    "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize", "owner": "holder",
    "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful", "noncommercial": "non commercial", "sublicence": "sublicense",
}

# Licence notices and short licences, as published.
KNOWN = {
    "MIT-notice": ["Released under the MIT License.", "Licensed under the MIT License."],
    "Apache-2.0-notice": ["Licensed under the Apache License, Version 2.0."],
    "GPL-3.0-notice": ["This work is licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0-notice": ["Licensed under CC BY-NC 4.0."],
    "ISC": ["""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""],
    "MIT": ["""MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""],
}

# Words with which a licence, or its title, goes on after a copyright notice in the same paragraph.
BODY = ["permission is", "permission to", "redistribution and use", "redistribution of", "everyone is permitted", "licensed under", "licensed to", "released under",
        "distributed under", "verbatim copying", "this software", "this program", "this library", "this file", "this work", "this source", "this package", "this license",
        "this licence", "this document", "this product", "you may", "mit license", "mit licence", "isc license", "isc licence", "bsd license", "apache license",
        "zlib license"]

#: A copyright notice: the word with a sign, a year or a placeholder, or a sign with a year. The holder may be anything, so the notice ends where
#: licence wording goes on, or with its paragraph; it does not matter how its lines are broken. Written for Python and for the engine of
#: the comparison SQL alike.
_YEAR = r"[12][0-9][0-9][0-9]"
_SIGN = r"(?:©|\(c\))"
_GO_ON = "|".join(p.replace(" ", r"\s+") for p in BODY)
NOTICE = rf"(?i)(?:\bcopyright[\s,:.-]*(?:{_SIGN}|[<\[{{]*(?:{_YEAR}|year|yyyy|date))|{_SIGN}[\s,:.-]*(?:copyright[\s,:.-]*)?{_YEAR})[\s\S]*?(?:\b({_GO_ON})\b|END)"
#: A paragraph of the word and names alone, or of a sign and up to four words, without a year.
SHORT = r"START[^\w©]*(?:Copyright(?:\s+(?:[A-Z]\S*|by|and|of|the|&))+|(?:©|\([cC]\))(?:\s+\S+){1,4})\W*END"
RESERVED = r"(?i)\ball\s+rights\s+reserved\b\W*"
GO_ON = rf"(?i){_GO_ON}"
_NOTICE, _SHORT = (re.compile(p.replace("START", r"\A").replace("END", r"\Z")) for p in (NOTICE, SHORT))
_RESERVED = re.compile(RESERVED)
_WORD = re.compile(r"[^\W_]+")
_BLANK = re.compile(r"\n[ \t\r]*\n")


def _wording(paragraph: str) -> str:
    """A paragraph without copyright notices."""
    low = paragraph.lower()
    if not any(sign in low for sign in ("copyright", "©", "(c)", "reserved")):
        return paragraph
    bare = _RESERVED.sub(" ", paragraph)
    bare = _NOTICE.sub(lambda m: m.group(1) or "", bare)
    return "" if _SHORT.match(bare) and not re.search(GO_ON, bare) else bare


def canonical(text: str) -> str:
    """Words in lower case with one space between; copyright notices gone, equivalent spellings made one. Line breaks within a paragraph do not matter."""
    return " ".join(SPELLINGS.get(w, w) for p in _BLANK.split(text) for w in _WORD.findall(_wording(p).lower()))


def digest(text: str) -> bytes | None:
    """SHA-256 of the canonical text; null if no word is left."""
    text = canonical(text)
    return hashlib.sha256(text.encode()).digest() if text else None


#: Words by which a known text is told to begin.
BEGIN = 3
#: Bytes of a digest by which a run is told to be worth a lookup.
PREFIX = 8
#: Licence, first words, number of words and digest of published texts, written by license_table.py.
TABLE = Path(__file__).with_name("licenses.csv")


def paragraphs(text: str) -> int:
    """Blocks between blank lines."""
    return len(_BLANK.findall(text.strip("\n"))) + 1


def units(text: str, begins: dict[str, dict[int, set[bytes]]] | None = None) -> Iterator[tuple[str, int, str]]:
    """(kind, first code point, text): the whole text; runs of blocks between blank lines that have a line break and are not the
    whole; every line that is not empty, if there are several.

    `begins` tells of known texts the first words, then numbers of words, then digest prefixes: a run begins at a block with such
    words and ends at the block that completes such a number, however the words are cut into blocks. Blocks without words (empty,
    or of a copyright notice only) neither begin nor end a run; a run inside a longer known one is not told.
    Without `begins` every block is a run.
    """
    yield "text", 0, text
    gaps = [(m.start(), m.end()) for m in _BLANK.finditer(text)]
    starts, ends = [0, *(e for _, e in gaps)], [*(s for s, _ in gaps), len(text)]
    for i, j in _runs([text[s:e] for s, e in zip(starts, ends, strict=True)], begins) if gaps else ():
        if "\n" in text[starts[i]:ends[j]]:
            yield "block", starts[i], text[starts[i]:ends[j]]
    at = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line:
                yield "line", at, line
            at += len(line) + 1


def _runs(blocks: list[str], begins: dict[str, dict[int, set[bytes]]] | None) -> Iterator[tuple[int, int]]:
    """First and last block of every run that is not the whole."""
    if begins is None:
        yield from ((i, i) for i in range(len(blocks)))
        return
    words = [canonical(b).split() for b in blocks]
    upto = list(accumulate(map(len, words)))
    told = -1  # last block of the runs so far
    for i, own in enumerate(words):
        if not own:
            continue
        first, k = own[:BEGIN], i + 1
        while len(first) < BEGIN and k < len(words):
            first, k = first + words[k][:BEGIN - len(first)], k + 1
        sizes: dict[int, set[bytes]] = {}
        for n in range(1, len(first) + 1):
            for size, prefixes in begins.get(" ".join(first[:n]), {}).items():
                sizes.setdefault(size, set()).update(prefixes)
        for n in sorted(sizes, reverse=True):
            end = upto[i] - len(own) + n
            j = bisect_left(upto, end)
            if j <= told or j == len(upto) or upto[j] != end:
                continue
            if hashlib.sha256(" ".join(chain.from_iterable(words[i:j + 1])).encode()).digest()[:PREFIX] in sizes[n]:
                told = j
                if i or j + 1 < len(words):
                    yield i, j
                break


def known_digests(spark: SparkSession, known: dict[str, list[str]] | None = None) -> DataFrame:
    """(known, license_id, begin, words), one row per canonical text; of equal texts the licence that sorts first.

    Without `known`: the texts of KNOWN and the published ones of TABLE.
    """
    rows = [(name, text, digest(text)) for name, texts in (KNOWN if known is None else known).items() for text in texts]
    cells = [(d, name, " ".join(canonical(text).split()[:BEGIN]), len(canonical(text).split())) for name, text, d in rows if d is not None]
    if known is None:
        with TABLE.open(newline="") as lines:
            cells += [(bytes.fromhex(r["digest"]), r["license_id"], r["begin"], int(r["words"])) for r in csv.DictReader(lines)]
    one = {c[0]: c for c in sorted(cells, key=lambda c: c[1], reverse=True)}
    columns = list(zip(*one.values(), strict=True)) or [()] * 4
    kinds = {"known": pa.binary(), "license_id": pa.string(), "begin": pa.string(), "words": pa.int64()}
    return spark.createDataFrame(pa.table({n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns, strict=True)}))


#: Numbers of blocks that the texts of KNOWN have; the comparison SQL knows only these texts.
RUNS = tuple(sorted({paragraphs(t) for texts in KNOWN.values() for t in texts}))


def license_scan(df: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Look whole texts, runs of blocks and lines up among known licences.

    Rows: `id_col`, unit (text, block, line), start (code point), digest (hex, canonical text), license_id. Every row of `df`
    has its text unit, with a null licence if it is none and a null digest if it has no word (null, empty, punctuation
    or copyright notices only); blocks and lines come only where they are a licence. `known` may be any table like that of
    `known_digests`, which is the default; the driver receives first words, length and eight bytes of the digest of each of its texts,
    which say where runs of blocks begin and end. Null ids and repeated rows are scanned like any other; other
    columns are not looked at; an empty table gives an empty result.

    Digests leave Python, the lookup is a hash join: broadcast by Spark if the known table is small, else by digest.
    """
    known = known_digests(df.sparkSession) if known is None else known
    begins: dict[str, dict[int, set[bytes]]] = {}
    for begin, n, prefix in known.select("begin", "words", F.substring("known", 1, PREFIX)).distinct().collect():
        begins.setdefault(begin, {}).setdefault(n, set()).add(bytes(prefix))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [(i, unit, start, d) for i, text in enumerate(part.column(1).to_pylist()) for unit, start, piece in units(text, begins)
                        if (d := digest(piece)) is not None or unit == "text"]
                of, unit, start, found = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(unit), pa.array(start, pa.int64()), pa.array(found, pa.binary())],
                                                 ["id", "unit", "start", "digest"])

    found = df.select(F.col(id_col).alias("id"), letters(text_col).alias("text")).mapInArrow(run, f"id {kind}, unit string, start long, digest binary")
    joined = found.join(known.select("known", "license_id"), F.col("digest") == F.col("known"), "left").where("unit = 'text' OR license_id IS NOT NULL")
    return joined.select(F.col("id").alias(id_col), "unit", "start", F.lower(F.hex("digest")).alias("digest"), "license_id")
