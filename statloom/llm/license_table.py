"""Write statloom/llm/licenses.csv: canonical digests of published licence texts and notices, found in the folders given.

    python -m statloom.llm.license_table /usr/share/common-licenses FOLDER...

Each text is taken whole, without its leading title, and up to the end of its terms (without instructions on how to apply it).
Copies in other packages differ only in copyright lines, which the canonical text leaves out (as notices, however they are wrapped).
"""

import csv
import re
import sys
from pathlib import Path

from statloom.llm import licenses

# Licence, end of the path of a published copy.
SOURCES = [
    ("Apache-2.0", "common-licenses/Apache-2.0"), ("Apache-2.0", "supports-hyperlinks-3.1.0/LICENSE"), ("Apache-2.0", "utf8-zero-0.8.1/LICENSE-APACHE"),
    ("Apache-2.0", "dirs-6.0.0/LICENSE-APACHE"), ("Artistic-1.0-Perl", "common-licenses/Artistic"), ("BSD-3-Clause", "common-licenses/BSD"),
    ("BSD-3-Clause", "npm/node_modules/diff/LICENSE"), ("BSD-3-Clause", "ed25519-dalek-2.1.1/LICENSE"), ("BSD-3-Clause", "subtle-2.6.1/LICENSE"),
    ("BSD-2-Clause", "node_modules/extract-zip/LICENSE"), ("BSD-2-Clause", "packaging/LICENSE.BSD"), ("BSD-2-Clause", "esutils/LICENSE.BSD"),
    ("BSD-2-Clause", "npm-user-validate/LICENSE"), ("BlueOak-1.0.0", "npm/node_modules/tar/LICENSE.md"), ("CC0-1.0", "common-licenses/CC0-1.0"),
    ("GFDL-1.2", "common-licenses/GFDL-1.2"), ("GFDL-1.3", "common-licenses/GFDL-1.3"), ("GPL-1.0", "common-licenses/GPL-1"),
    ("GPL-2.0", "common-licenses/GPL-2"), ("GPL-3.0", "common-licenses/GPL-3"), ("GPL-3.0", "libunistring-1.3-hb25bd0a_0/info/licenses/COPYING"),
    ("ISC", "rustls-0.23.37/LICENSE-ISC"), ("LGPL-2.0", "common-licenses/LGPL-2"), ("LGPL-2.1", "common-licenses/LGPL-2.1"),
    ("LGPL-3.0", "common-licenses/LGPL-3"), ("MIT", "globset-0.4.18/LICENSE-MIT"), ("MIT", "crc32fast-1.5.0/LICENSE-MIT"),
    ("MPL-1.1", "common-licenses/MPL-1.1"), ("MPL-2.0", "common-licenses/MPL-2.0"), ("PSF-2.0", "node_modules/argparse/LICENSE"),
    ("0BSD", "adler2-2.0.1/LICENSE-0BSD"), ("Unicode-3.0", "finl_unicode-1.4.0/LICENSE-UNICODE"), ("Unlicense", "globset-0.4.18/UNLICENSE"),
    ("Zlib", "miniz_oxide-0.8.9/LICENSE-ZLIB.md"), ("Apache-2.0 WITH LLVM-exception", "rustix-1.0.7/LICENSE-Apache-2.0_WITH_LLVM-exception"),
]
# Titles that published copies of a text carry, or leave out.
TITLES = {"MIT": ["MIT", "MIT License", "MIT License (MIT)", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "ISC License (ISC)", "The ISC License"],
          "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License"], "BSD-2-Clause": ["BSD 2-Clause License", "The BSD License", "BSD License"],
          "Zlib": ["zlib License", "The zlib License"], "Unlicense": ["The Unlicense"], "0BSD": ["Zero-Clause BSD", "BSD Zero Clause License"]}
# Where the terms of a text end and its instructions begin.
_END = re.compile(r"\n[^\n]*(?=\n\s*(?:APPENDIX: How to apply|Appendix: How to Apply|How to Apply These Terms|ADDENDUM: How to use|Exhibit A - |EXHIBIT A ))|(?=\n\s*(?:END OF TERMS AND CONDITIONS))")
_AFTER = re.compile(r"(?<=END OF TERMS AND CONDITIONS)")
# Notices that the texts give, from the words they begin with to those they end with.
_NOTICES = [re.compile(p, re.S) for p in (
    r"Licensed under the Apache License, Version 2\.0 \(the .*?limitations under the License\.", r"This Source Code Form is subject to the terms.*?MPL/2\.0/\.",
    r"This (?:program|library) is free software[:;].*?(?:any\s+later\s+version\.)", r"This (?:program|library) is free software[:;].*?General Public License\s+for more details\.",
    r"This (?:program|library) is free software[:;].*?(?:along\s+with this (?:program|library).*?(?:USA\.?|licenses/>\.))")]


def variants(name: str, text: str):
    """The text and its shorter forms, with and without titles."""
    forms = [text, *(text[:m.start()] for m in (*_END.finditer(text), *_AFTER.finditer(text)))]
    for form in forms:
        if len(licenses.canonical(form).split()) < 40:
            continue
        yield form
        blocks = re.split(r"\n[ \t\r]*\n", form.strip("\n"))
        while blocks and len(licenses.canonical(blocks[0]).split()) <= 14:
            blocks.pop(0)
        yield "\n\n".join(blocks)
        for title in TITLES.get(name, []):
            yield "\n\n".join([title, *blocks])
    for notice in _NOTICES:
        for m in notice.finditer(text):
            yield f"{name}-notice", m.group()


def main(folders: list[str]) -> None:
    files = [str(p) for f in folders for p in sorted(Path(f).rglob("*")) if p.is_file()]
    found: dict[str, tuple] = {}
    for name, end in SOURCES:
        paths = [p for p in files if p.endswith("/" + end)]
        if not paths:
            raise SystemExit(f"no copy of {name} at {end}")
        text = Path(paths[0]).read_text(encoding="utf8")
        own = [(name, v) if isinstance(v, str) else v for v in variants(name, text)]
        own.append((f"{name}-notice", f"SPDX-License-Identifier: {name}"))
        for of, form in own:
            d, words = licenses.digest(form), licenses.canonical(form).split()
            found.setdefault(d.hex(), (of, " ".join(words[:licenses.BEGIN]), len(words), d.hex()))
    with open(licenses.TABLE, "w", newline="") as out:
        csv.writer(out, lineterminator="\n").writerows([("license_id", "begin", "words", "digest"), *sorted(found.values())])


if __name__ == "__main__":
    main(sys.argv[1:])
