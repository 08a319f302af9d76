"""The operators for training data do the whole job."""

import textwrap

from tests.llm.conftest import table
from tideline.llm import licenses

REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
CONDITIONS = [
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of Example nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
]
DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT OWNER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def layouts(parts):
    head, *rest = parts
    text = "\n\n".join([head, *(textwrap.fill(p, 76) for p in rest)])
    return [text, head + "\n\n" + textwrap.fill(" ".join(rest), 76), text.replace("\n\n", "\n"), "\n".join((" * " + x).rstrip() for x in text.split("\n"))]


def test_whole_license_files_in_usual_layouts(spark):
    copyright = "Copyright (c) 2020, Example. All rights reserved."
    bullets = [[f"{m} {c}" for m, c in zip(marks, CONDITIONS, strict=True)] for marks in (("1.", "2.", "3."), "***")]
    files = [("BSD-2-Clause", t) for b in bullets for t in layouts([copyright, REDISTRIBUTION, *b[:2], DISCLAIMER])]
    files += [("BSD-3-Clause", t) for b in bullets for t in layouts([copyright, REDISTRIBUTION, *b, DISCLAIMER])]
    for name in ("MIT", "ISC", "Apache-2.0", "Artistic-1.0", "BSL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "CC0-1.0", "Unlicense", "Zlib"):
        whole = max((t for n, t in licenses.TEMPLATES if n == name), key=len)
        files += [(name, t) for t in layouts([copyright, *(p for p in whole.split("\n\n") if p.strip())])]
    got = licenses.scan(table(spark, list(enumerate(t for _, t in files)))).collect()
    # a text without empty lines is one paragraph
    whole = {(r["doc_id"], r["license"]) for r in got if r["level"] == ("document" if "\n\n" in files[r["doc_id"]][1] or " *\n" in files[r["doc_id"]][1] else "paragraph")}
    assert [(i, n) for i, (n, _) in enumerate(files) if (i, n) not in whole] == []
    sizes = [len(t) for n, t in files if n == "GPL-3.0"]
    assert min(sizes) > 30_000


def test_license_paragraphs_inside_other_text(spark):
    prose = textwrap.fill(" ".join(f"word{i}" for i in range(300)), 76)
    middle = "\n\n".join([prose, textwrap.fill(" ".join([REDISTRIBUTION, *CONDITIONS]), 76), textwrap.fill(DISCLAIMER, 76), prose])
    got = {(r["level"], r["license"]) for r in licenses.scan(table(spark, [(1, middle)])).collect()}
    assert got == {("paragraph", "BSD-3-Clause"), ("paragraph", "BSD-2-Clause")}


def test_affero_and_lesser_notices_have_their_own_names(spark):
    names = ("AGPL-3.0", "GPL-3.0", "LGPL-2.1", "EPL-2.0")
    notices = [textwrap.fill(min((t for n, t in licenses.TEMPLATES if n == name and len(t) > 120), key=len), 70) for name in names]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(table(spark, list(enumerate(notices)))).where("level = 'paragraph'").collect()}
    assert got == dict(enumerate(names))
