"""The published wording of licences, in their usual title forms, and of licence notices.

Short licences are spelled out here; long ones are the published files in ``license_files``. A digest is that of a whole text, so
each form in which a text is handed on (title, numbers or bullets, with or without the appendix that tells how to apply it) is an entry.
"""

from importlib.resources import files

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC = f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_REST}"
_MIT, _0BSD = f"{_MIT_GRANT}\n\n{_MIT_REST}", f"{_ISC_GRANT}.\n\n{_ISC_REST}"
_BSD2, _BSD3 = f"{_BSD_HEAD}\n\n{_BSD_REST}", f"{_BSD_HEAD}\n\n{_BSD_THIRD}\n\n{_BSD_REST}"

TEXTS = {
    "MIT": f"MIT License\n\nCopyright (c) <year> <copyright holders>\n\n{_MIT}",
    "MIT (without title)": _MIT,
    "ISC": f"ISC License\n\n{_ISC}",
    "0BSD": _0BSD,
    "BSD-2-Clause": _BSD2,
    "BSD-3-Clause": _BSD3,
    "ISC (without title)": _ISC,
}

#: Titles that stand above the texts as well.
_TITLES = {
    "MIT": (_MIT, ("The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License")),
    "ISC": (_ISC, ("The ISC License", "ISC License (ISC)", "The ISC License (ISC)")),
    "0BSD": (_0BSD, ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License (0BSD)")),
    "BSD-2-Clause": (_BSD2, ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License", 'BSD 2-Clause "Simplified" License')),
    "BSD-3-Clause": (_BSD3, ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "BSD License", "New BSD License", "Modified BSD License", 'BSD 3-Clause "New" or "Revised" License')),
}
TEXTS |= {f"{k} ({title})": f"{title}\n\n{text}" for k, (text, titles) in _TITLES.items() for title in titles}
TEXTS |= {f"{k}, bullets": v.replace("1. R", "* R").replace("2. R", "* R").replace("3. N", "* N") for k, v in TEXTS.items() if k.startswith("BSD-")}

#: Long licences: the name of the file, and where the part begins that tells how to apply the licence.
_FILES = {
    "Apache-2.0": ("Apache-2.0", "   APPENDIX: How to apply"), "CC0-1.0": ("CC0-1.0", None), "GPL-2.0": ("GPL-2", "            How to Apply"), "GPL-3.0": ("GPL-3", "            How to Apply"),
    "LGPL-2.0": ("LGPL-2", "           How to Apply"), "LGPL-2.1": ("LGPL-2.1", "           How to Apply"), "LGPL-3.0": ("LGPL-3", None), "MPL-1.1": ("MPL-1.1", None), "MPL-2.0": ("MPL-2.0", "Exhibit A - "),
}
for _k, (_file, _appendix) in _FILES.items():
    TEXTS[_k] = files(__package__).joinpath("license_files", f"{_file}.txt").read_text(encoding="utf-8")
    if _appendix:
        TEXTS[f"{_k} (without appendix)"] = TEXTS[_k][: TEXTS[_k].index(_appendix.strip())]

NOTICES = {
    "MIT (notice)": "Released under the MIT License.",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
}
