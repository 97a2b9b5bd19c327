"""License scan: ordered signature rules over the words of a text.

A text's words are its runs of ASCII letters (lower-cased), digits and
characters beyond ASCII; all tests run over the words joined by single blanks.

* **Rules.** Every license family below has a hand-written pattern of its name
  and may have ones of its address and of its own sentences.  Each family gives
  up to four rules: the SPDX tag, a grant ("licensed under the terms of the ..."),
  the address, and the plain name; notices of no family follow.  Together they are
  some 450 regular expressions.
* **Prefilter.** A rule runs only where one of its keywords stands in the text: literal
  parts, one of which is in all that the rule matches.
* **Overlaps.** Detections are taken by priority (tag, grant, sentence, address, name,
  notice), then longest first, then leftmost; one that lies inside the words of a
  detection already taken is suppressed.  What merely overlaps stays.

Base phrases are counted apart and their labels always stay.  ``score`` is the
largest confidence of what was found, 0 where nothing was.

One pass over the rows, no shuffle; texts are read whole, a batch of rows at a
time.  A null text is an empty one: no words, no labels (empty strings), score 0.
Repeated rows and null ids give a row each; extra columns do not matter and are
not returned.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, spans array<struct<label: string, start: long, length: long, confidence: double>>")

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_CONFIDENCE = 0.5

#: Priority and confidence of each kind of rule, best first.
KINDS = {"tag": (0, 1.0), "grant": (1, 0.95), "sentence": (2, 0.9), "address": (3, 0.85), "name": (4, 0.75), "notice": (5, 0.4)}

# Patterns see words parted by single blanks: "2.0" reads "2 0", "GPL-3.0+" reads "gpl 3 0".
_L = r"licen[cs]es?"
_V = r"(?:v|ver|version|v )? ?"

#: label | keywords, any of which the name holds | pattern of the name (with "license" where the name needs it) | pattern of the address
FAMILIES = rf"""
mit | mit | (?:the )?(?:expat )?mit(?: x11| expat)? {_L} | opensource org licenses? mit
mit-0 | mit | mit no attribution(?: {_L})? | opensource org licenses? mit 0
x11 | x11 | x11 {_L} | spdx org licenses x11
isc | isc | isc {_L} | opensource org licenses? isc
apache-1.0 | apache | apache(?: software)? {_L} {_V}1 0 | apache org licenses license 1 0
apache-1.1 | apache | apache(?: software)? {_L} {_V}1 1 | apache org licenses license 1 1
apache-2.0 | apache | apache(?: software)?(?: foundation)?(?: {_L})? {_V}2(?: 0)?(?: {_L})? | apache org licenses license 2 0
apache | apache | apache(?: software)?(?: foundation)? {_L} | apache org licenses
bsd-2-clause | bsd | (?:2|two) clause(?: simplified)? bsd(?: {_L})?|simplified bsd {_L}|freebsd {_L}|bsd 2 clause(?: {_L})? | opensource org licenses? bsd 2 clause
bsd-3-clause | bsd | (?:3|three) clause bsd(?: {_L})?|(?:new|modified|revised) bsd {_L}|bsd 3 clause(?: {_L})? | opensource org licenses? bsd 3 clause
bsd-4-clause | bsd | (?:4|four) clause bsd(?: {_L})?|original bsd {_L}|bsd 4 clause(?: {_L})? | spdx org licenses bsd 4 clause
0bsd | bsd | (?:zero clause bsd|bsd zero clause|0bsd)(?: {_L})? | opensource org licenses? 0bsd
bsd | bsd | bsd(?: style)? {_L} | opensource org licenses? bsd
gpl-1.0 | general public, gpl | (?:gnu )?(?:general public {_L}|gpl) {_V}1(?: 0)? | gnu org licenses (?:old licenses )?gpl 1 0
gpl-2.0 | general public, gpl | (?:gnu )?(?:general public {_L}|gpl) {_V}2(?: 0)?(?: only)? | gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0 | general public, gpl | (?:gnu )?(?:general public {_L}|gpl) {_V}3(?: 0)?(?: only)? | gnu org licenses gpl 3 0
gpl-2.0-or-later | general public, gpl | (?:gnu )?(?:general public {_L}|gpl) {_V}2(?: 0)? (?:of the license )?or(?: at your option)? (?:any )?later(?: version)? | gnu org licenses gpl 2 0 or later
gpl-3.0-or-later | general public, gpl | (?:gnu )?(?:general public {_L}|gpl) {_V}3(?: 0)? (?:of the license )?or(?: at your option)? (?:any )?later(?: version)? | gnu org licenses gpl 3 0 or later
gpl | general public, gpl | gnu gpl|(?:gnu )?general public {_L}|gpl {_L} | gnu org (?:copyleft gpl|licenses gpl)
lgpl-2.0 | general public, lgpl | (?:gnu )?(?:library general public {_L}|lgpl) {_V}2(?: 0)? | gnu org licenses (?:old licenses )?lgpl 2 0
lgpl-2.1 | general public, lgpl | (?:gnu )?(?:lesser general public {_L}|lgpl) {_V}2 1 | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0 | general public, lgpl | (?:gnu )?(?:lesser general public {_L}|lgpl) {_V}3(?: 0)? | gnu org licenses lgpl 3 0
lgpl | general public, lgpl | gnu lgpl|(?:gnu )?(?:lesser|library) general public {_L}|lgpl {_L} | gnu org (?:copyleft lesser|licenses lgpl)
agpl-3.0 | affero, agpl | (?:gnu )?(?:affero general public {_L}|agpl) {_V}3(?: 0)? | gnu org licenses agpl 3 0
agpl | affero, agpl | gnu agpl|(?:gnu )?affero general public {_L}|agpl {_L} | gnu org licenses agpl
gfdl-1.1 | free documentation, fdl | (?:gnu )?(?:free documentation {_L}|gfdl|fdl) {_V}1 1 | gnu org licenses fdl 1 1
gfdl-1.2 | free documentation, fdl | (?:gnu )?(?:free documentation {_L}|gfdl|fdl) {_V}1 2 | gnu org licenses fdl 1 2
gfdl-1.3 | free documentation, fdl | (?:gnu )?(?:free documentation {_L}|gfdl|fdl) {_V}1 3 | gnu org licenses fdl 1 3
gfdl | free documentation, fdl | gnu fdl|(?:gnu )?free documentation {_L}|gfdl | gnu org copyleft fdl
mpl-1.0 | mozilla public, mpl | (?:mozilla public {_L}|mpl) {_V}1(?: 0)? | mozilla org mpl 1 0
mpl-1.1 | mozilla public, mpl | (?:mozilla public {_L}|mpl) {_V}1 1 | mozilla org mpl 1 1
mpl-2.0 | mozilla public, mpl | (?:mozilla public {_L}|mpl) {_V}2(?: 0)? | mozilla org (?:en us )?mpl 2 0
mpl | mozilla public | mozilla public {_L} | mozilla org (?:en us )?mpl
epl-1.0 | eclipse public, epl | (?:eclipse public {_L}|epl) {_V}1(?: 0)? | eclipse org legal epl v10
epl-2.0 | eclipse public, epl | (?:eclipse public {_L}|epl) {_V}2(?: 0)? | eclipse org legal epl (?:v20|2 0)
epl | eclipse public | eclipse public {_L} | eclipse org legal epl
cddl-1.0 | common development, cddl | (?:common development and distribution {_L}|cddl)(?: cddl)? {_V}1(?: 0)? | opensource org licenses? cddl 1 0
cddl-1.1 | common development, cddl | (?:common development and distribution {_L}|cddl)(?: cddl)? {_V}1 1 | spdx org licenses cddl 1 1
cddl | common development | common development and distribution {_L} | opensource org licenses? cddl
cpl-1.0 | common | common public {_L}(?: {_V}1 0)? | opensource org licenses? cpl 1 0
cc-by-1.0 | cc by, creative commons | (?:cc by|creative commons attribution)(?: (?:generic )?{_L})? {_V}1 0 | creativecommons org licenses by 1 0
cc-by-2.0 | cc by, creative commons | (?:cc by|creative commons attribution)(?: (?:generic )?{_L})? {_V}2 0 | creativecommons org licenses by 2 0
cc-by-2.5 | cc by, creative commons | (?:cc by|creative commons attribution)(?: (?:generic )?{_L})? {_V}2 5 | creativecommons org licenses by 2 5
cc-by-3.0 | cc by, creative commons | (?:cc by|creative commons attribution)(?: (?:unported )?{_L})? {_V}3 0(?: unported)? | creativecommons org licenses by 3 0
cc-by-4.0 | cc by, creative commons | (?:cc by|creative commons attribution)(?: (?:international )?{_L})? {_V}4 0(?: international)? | creativecommons org licenses by 4 0
cc-by-sa-2.0 | cc by, creative commons | (?:cc by sa|creative commons attribution share ?alike)(?: {_L})? {_V}2 0 | creativecommons org licenses by sa 2 0
cc-by-sa-2.5 | cc by, creative commons | (?:cc by sa|creative commons attribution share ?alike)(?: {_L})? {_V}2 5 | creativecommons org licenses by sa 2 5
cc-by-sa-3.0 | cc by, creative commons | (?:cc by sa|creative commons attribution share ?alike)(?: {_L})? {_V}3 0(?: unported)? | creativecommons org licenses by sa 3 0
cc-by-sa-4.0 | cc by, creative commons | (?:cc by sa|creative commons attribution share ?alike)(?: {_L})? {_V}4 0(?: international)? | creativecommons org licenses by sa 4 0
cc-by-sa | cc by, creative commons | cc by sa|creative commons attribution share ?alike(?: {_L})? | creativecommons org licenses by sa
cc-by-nc-3.0 | cc by, creative commons | (?:cc by nc|creative commons attribution non ?commercial)(?: {_L})? {_V}3 0 | creativecommons org licenses by nc 3 0
cc-by-nc-4.0 | cc by, creative commons | (?:cc by nc|creative commons attribution non ?commercial)(?: {_L})? {_V}4 0 | creativecommons org licenses by nc 4 0
cc-by-nc | cc by, creative commons | cc by nc|creative commons attribution non ?commercial(?: {_L})? | creativecommons org licenses by nc
cc-by-nd-3.0 | cc by, creative commons | (?:cc by nd|creative commons attribution no ?deriv(?:s|atives|ative works))(?: {_L})? {_V}3 0 | creativecommons org licenses by nd 3 0
cc-by-nd-4.0 | cc by, creative commons | (?:cc by nd|creative commons attribution no ?deriv(?:s|atives|ative works))(?: {_L})? {_V}4 0 | creativecommons org licenses by nd 4 0
cc-by-nd | cc by, creative commons | cc by nd|creative commons attribution no ?deriv(?:s|atives|ative works) | creativecommons org licenses by nd
cc-by-nc-sa-3.0 | cc by, creative commons | (?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: {_L})? {_V}3 0 | creativecommons org licenses by nc sa 3 0
cc-by-nc-sa-4.0 | cc by, creative commons | (?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: {_L})? {_V}4 0 | creativecommons org licenses by nc sa 4 0
cc-by-nc-sa | cc by, creative commons | cc by nc sa|creative commons attribution non ?commercial share ?alike | creativecommons org licenses by nc sa
cc-by-nc-nd-3.0 | cc by, creative commons | (?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works))(?: {_L})? {_V}3 0 | creativecommons org licenses by nc nd 3 0
cc-by-nc-nd-4.0 | cc by, creative commons | (?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works))(?: {_L})? {_V}4 0 | creativecommons org licenses by nc nd 4 0
cc-by-nc-nd | cc by, creative commons | cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works) | creativecommons org licenses by nc nd
cc-by | cc by, creative commons | cc by {_L}|creative commons attribution(?: {_L})? | creativecommons org licenses by
cc0-1.0 | cc0, creative commons | cc0(?: 1 0)?(?: universal)?|creative commons (?:zero|cc0)(?: {_L})? | creativecommons org publicdomain zero 1 0
cc | creative commons | creative commons {_L} | creativecommons org licenses
unlicense | unlicen | (?:the )?unlicen[cs]e | unlicense org
wtfpl | wtfpl, what the fuck | wtfpl|do what the fuck you want to public {_L} | wtfpl net
zlib | zlib | zlib(?: libpng)? {_L} | opensource org licenses? zlib
libpng | libpng | libpng {_L} | libpng org pub png src libpng license
boost-1.0 | boost | boost software {_L}(?: {_V}1 0)? | boost org license 1 0
artistic-1.0 | artistic | artistic {_L} {_V}1(?: 0)? | opensource org licenses? artistic 1 0
artistic-2.0 | artistic | artistic {_L} {_V}2(?: 0)? | opensource org licenses? artistic 2 0
artistic | artistic | artistic {_L} | opensource org licenses? artistic
afl-3.0 | academic | academic free {_L}(?: {_V}3 0)? | opensource org licenses? afl 3 0
osl-3.0 | open software | open software {_L}(?: {_V}3 0)? | opensource org licenses? osl 3 0
eupl-1.1 | european union public, eupl | (?:european union public licen[cs]e|eupl) {_V}1 1 | spdx org licenses eupl 1 1
eupl-1.2 | european union public, eupl | (?:european union public licen[cs]e|eupl) {_V}1 2 | spdx org licenses eupl 1 2
eupl | european union public, eupl | european union public licen[cs]e|eupl | joinup ec europa eu (?:software page|collection) eupl
ms-pl | microsoft | microsoft public {_L} | opensource org licenses? ms pl
ms-rl | microsoft | microsoft reciprocal {_L} | opensource org licenses? ms rl
python-2.0 | python | (?:psf|python software foundation|python) {_L}(?: {_V}2(?: 0)?)? | docs python org license
php-3.01 | php | php {_L}(?: {_V}3 01)? | php net license 3 01
ruby | ruby | ruby {_L} | ruby lang org en about license
postgresql | postgresql | postgresql {_L} | postgresql org about licen[cs]e
ofl-1.1 | open font, sil ofl | (?:sil )?open font {_L}(?: {_V}1 1)?|sil ofl | scripts sil org ofl
ubuntu-font | ubuntu | ubuntu font {_L}(?: {_V}1 0)? | font ubuntu com licence
odbl-1.0 | open database, odbl | (?:odc )?open database {_L}(?: {_V}1 0)?|odbl | opendatacommons org licenses odbl
odc-by-1.0 | odc by, open data commons | (?:odc by|open data commons attribution {_L}) | opendatacommons org licenses by
pddl-1.0 | pddl, public domain dedication | pddl|public domain dedication and {_L} | opendatacommons org licenses pddl
ogl-uk-3.0 | open government | open government {_L}(?: {_V}3 0)? | nationalarchives gov uk doc open government licence
cecill-2.1 | cecill | cecill(?: free software {_L})?(?: {_V}2 1)? | cecill info licences
wx | wxwindows | wxwindows(?: library)? {_L} | wxwidgets org about licence
vim | vim | vim {_L} | vimhelp org uganda
openssl | openssl | openssl {_L} | openssl org source license
curl | curl | curl {_L} | curl se docs copyright
tcl | tcl | tcl tk {_L}|tcl {_L} | tcl tk software tcltk license
w3c | w3c | w3c software(?: notice)?(?: and)? {_L} | w3 org consortium legal 2015 copyright software
ncsa | ncsa | (?:university of illinois )?(?:uiuc )?ncsa(?: open source)? {_L} | opensource org licenses? ncsa
upl-1.0 | universal | universal permissive {_L}(?: {_V}1 0)? | oss oracle com licenses upl
bsl-1.1 | business | business source {_L}(?: {_V}1 1)? | mariadb com bsl11
sspl-1.0 | server side public, sspl | server side public {_L}(?: {_V}1(?: 0)?)?|sspl | mongodb com licensing server side public license
elastic-2.0 | elastic | elastic {_L}(?: {_V}2(?: 0)?)? | elastic co licensing elastic license
polyform-nc | polyform | polyform noncommercial {_L}(?: {_V}1 0 0)? | polyformproject org licenses noncommercial
openrail | rail | (?:creativeml |bigscience )?open ?rail(?: m)?(?: {_L})? | huggingface co spaces bigscience license
"""

#: label | keyword | pattern of a sentence of the license's own text
SENTENCES = r"""
mit | hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software
isc | hereby granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
apache-2.0 | except in compliance | you may not use this file except in compliance with the license
gpl | redistribute it | you can redistribute it and or modify it under the terms of the gnu general public license
lgpl | redistribute it | you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
agpl | redistribute it | you can redistribute it and or modify it under the terms of the gnu affero general public license
mpl-2.0 | subject to the terms | this source code form is subject to the terms of the mozilla public license
zlib | in no event | in no event will the authors be held liable for any damages arising from the use of this software
boost-1.0 | accompanying documentation | obtaining a copy of the software and accompanying documentation covered by this license
unlicense | unencumbered | this is free and unencumbered software released into the public domain
cc0-1.0 | waived | (?:has|have) waived all copyright and related or neighboring rights
wtfpl | what the fuck | you just do what the fuck you want to
ofl-1.1 | font software | this font software is licensed under the sil open font license
public-domain | public domain | (?:released|placed|dedicated|donated)(?: in)?(?: to)? the public domain
"""

#: label | keyword | pattern of a notice of no family
NOTICES = r"""
copyright | copyright | copyright(?: c| ©)?(?: by)? (?:19|20)[0-9]{2}
copyright | copyright | copyright(?: c| ©) [^ ]+
copyright | © | ©(?: copyright)? (?:19|20)[0-9]{2}
reserved | reserved | all rights (?:are )?reserved
reserved | reserved | some rights reserved
reserved | vorbehalten | alle rechte vorbehalten
reserved | réservés | tous droits réservés
reserved | reservados | todos los derechos reservados
reserved | reservados | todos os direitos reservados
reserved | riservati | tutti i diritti riservati
public-domain | public domain | (?:is|are|now) in the public domain
public-domain | public domain | public domain (?:work|mark|dedication)
proprietary | proprietary | (?:proprietary and confidential|confidential and proprietary)
proprietary | proprietary | (?:is|under) (?:a )?proprietary licen[cs]e
proprietary | without permission | (?:may not be|do not|not to be) (?:copied|reproduced|copy|reproduce|redistribute|redistributed|distributed)(?: or [^ ]+)* without (?:prior |express |written |our )*permission
commercial | commercial | commercial licen[cs]e
eula | end user | end user licen[cs]e agreement
no-warranty | as is | (?:is )?provided as is without (?:any )?warrant(?:y|ies)(?: of any kind)?
no-warranty | warrant | without (?:even )?(?:the implied )?warrant(?:y|ies) of any kind
royalty-free | royalty free | royalty free licen[cs]e
dual | dual | dual licen[cs]ed
license-file | licen | see (?:the )?(?:file )?(?:license|licence|copying|license txt|license md)(?: file)? (?:file |in |for )
"""

_GRANT = (r"(?:licen[cs]ed|sublicen[cs]ed|released|distributed|redistributed|published|provided|available|covered|shared|offered) "
          r"(?:to you )?(?:under|subject to|in accordance with|by) (?:the |a |an )?(?:terms (?:and conditions )?of )?(?:the )?(?:following )?")


def _lines(table: str) -> Iterator[list[str]]:
    """The fields of each line; alternatives inside a pattern have no blanks around their bar."""
    for line in table.strip().splitlines():
        yield [part.strip() for part in line.split(" | ")]


def rules() -> list[tuple[str, tuple[bytes, ...], int, float, re.Pattern[bytes]]]:
    """(label, keywords, priority, confidence, compiled pattern) of every rule, in order."""
    out = []

    def add(kind: str, label: str, keywords: str, pattern: str) -> None:
        priority, confidence = KINDS[kind]
        out.append((label, tuple(k.encode() for k in keywords.split(", ")), priority, confidence,
                    re.compile(f"(?<= )(?:{pattern})(?= )".encode())))

    for label, keywords, name, address in _lines(FAMILIES):
        spdx = re.sub("[^0-9a-z]+", " ", label)
        add("tag", label, "spdx license identifier",
            f"spdx license identifier {spdx}(?! (?:[0-9]|or|sa|nc|nd|clause))")
        add("grant", label, keywords, f"{_GRANT}(?:{name})")
        add("address", label, address.split(" ")[0], address)
        add("name", label, keywords, name)
    for label, keywords, pattern in _lines(SENTENCES):
        add("sentence", label, keywords, pattern)
    for label, keywords, pattern in _lines(NOTICES):
        add("notice", label, keywords, pattern)
    return out


#: A-Z become lower case, other ASCII that is neither letter nor digit a blank; bytes beyond ASCII stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def _places(text: bytes, at: Iterator[int]) -> Iterator[int]:
    """The number of the word that starts at each of the ascending places; the text is walked once."""
    before, n = 0, 0
    for place in at:
        n += text.count(b" ", before, place)
        before = place
        yield n - 1


class Scanner:
    """The rules, compiled once per task, behind their keywords."""

    def __init__(self) -> None:
        self.rules = rules()
        self.keywords = sorted({k for _, keys, *_ in self.rules for k in keys})
        self.base = [(f" {p} ".encode(), label) for p, label in BASE.items()]

    def candidates(self, text: bytes) -> Iterator[tuple]:
        """The rules, one of whose keywords the text holds."""
        held = {k for k in self.keywords if k in text}
        return ((n, rule) for n, rule in enumerate(self.rules) if held and not held.isdisjoint(rule[1]))

    def detections(self, text: bytes) -> list[tuple[int, int, int, int, str, float]]:
        """(priority, -length, start, rule, label, confidence) of all matches, in words."""
        found = []
        for n, (label, _, priority, confidence, pattern) in self.candidates(text):
            spans = [m.span() for m in pattern.finditer(text)]
            for (a, z), start in zip(spans, _places(text, (a for a, _ in spans))):
                found.append((priority, -(1 + text.count(b" ", a, z)), start, n, label, confidence))
        return sorted(found)

    def scan(self, raw: bytes) -> tuple:
        words = raw.translate(_FOLD).split()
        text = b" " + b" ".join(words) + b" "
        starts, base_labels = [], set()
        for phrase, label in self.base:
            at = [m.start() for m in re.finditer(re.escape(phrase[:-1]) + b"(?= )", text)] if phrase in text else []
            starts += _places(text, (a + 1 for a in at))
            base_labels |= {label} if at else set()
        taken = uncontained(self.detections(text))
        labels = base_labels | {label for _, _, label, _ in taken}
        score = max([c for *_, c in taken] + [BASE_CONFIDENCE] * bool(starts), default=0.0)
        return (len(words), len(starts), min(starts, default=None), max(starts, default=None),
                ",".join(sorted(base_labels)), ",".join(sorted(labels)), score,
                [{"label": label, "start": s, "length": n, "confidence": c} for s, n, label, c in taken])


def uncontained(found: list[tuple]) -> list[tuple[int, int, str, float]]:
    """(start, length, label, confidence) of the detections, in their order, that lie inside none taken before.

    ``reach`` holds the taken intervals that no taken interval contains, by start: their
    ends ascend as well, so the last one that starts at or before a detection decides."""
    taken, starts, ends = [], [], []
    for _, less, start, _, label, confidence in found:
        end = start - less
        k = bisect_right(starts, start)
        if k and ends[k - 1] >= end:
            continue
        taken.append((start, -less, label, confidence))
        # intervals inside the new one leave the list
        low = bisect_left(starts, start)
        high = bisect_right(ends, end)
        starts[low:high], ends[low:high] = [start], [end]
    return taken


def _scanned(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        out = [scanner.scan(value.as_buffer().to_pybytes() if value.is_valid else b"") for value in batch.column(1)]
        columns = [batch.column(0), *(pa.array(c, schema.types[i + 1]) for i, c in enumerate(zip(*out)))]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score and ``spans``: the detections left (label, first word, words, confidence)."""
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, {SCHEMA}"
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], out).schema)
    return narrow.mapInArrow(lambda batches: _scanned(batches, schema), out)
