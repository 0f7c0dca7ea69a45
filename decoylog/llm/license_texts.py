"""Known licence texts and notices (fixed values, public texts).

Whole short licences, and the notices by which longer ones are applied.
"""

_PERMISSION = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so"""

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""

_MIT = f"""{_PERMISSION}, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

{_AS_IS}"""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted"""

_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""

_BSD_START = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
"""

_BSD_CLAUSES = """
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""

_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""

_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

_APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""

_MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""

_GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program. If not, see <https://www.gnu.org/licenses/>."""

KNOWN = {
    "0BSD": f"{_ISC}.\n\n{_ISC_END}",
    "Apache-2.0 (notice)": _APACHE,
    "Apache-2.0 (statement)": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": _BSD_START + _BSD_CLAUSES + _BSD_END,
    "BSD-3-Clause": _BSD_START + _BSD_CLAUSES + _BSD_THIRD + _BSD_END,
    "CC-BY-NC-4.0 (statement)": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-only (statement)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later (notice)": _GPL,
    "ISC": f"{_ISC}, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\n{_ISC_END}",
    "MIT": f"MIT License\n\n{_MIT}",
    "MIT (body)": _MIT,
    "MIT (statement)": "Released under the MIT License.",
    "MIT-0": f"MIT No Attribution\n\n{_PERMISSION}.\n\n{_AS_IS}",
    "MPL-2.0 (notice)": _MPL,
    "Zlib": _ZLIB,
}

#: Digests of the canonical forms of whole longer licences (``license_scan.with_digest``);
#: "(terms)" is the text up to the end of its terms, without the appendix on its use.
WHOLE = {
    "Apache-2.0": "e7f60d659d13ab87d77f3ec7161a0b37fcadba00bca1ae9359f5c78ee5ccbac9",
    "Apache-2.0 (terms)": "67b2cfda67ca97bcf37f8cf9ddc9cc915401f7c1d9e442adefe4e6db55b83ccb",
    "CC0-1.0": "85023310c86fc0a23a4d4df83138b5bb6ed1fe67f7d202bf4ada1cbbbd4603ac",
    "GFDL-1.2": "7e1243154282c1bc79aab9dde8543ca0dc7808b9b825a3cfb40058a474e5592f",
    "GFDL-1.3": "1cb34c2aa4cd59b68095d69aafbac58a575e1dc66fb886d58889affee583b392",
    "GPL-1.0": "6a989e9e3800b7bc5300e632e9306911e14a7f4e0fddaae76ec5fb86a5b72225",
    "GPL-1.0 (terms)": "8649e3bbab1d552a05e410225fee7b9e1c8adc4774c7a91f780ec78a7649dd69",
    "GPL-2.0": "852dfae4a45171f05a0954d9a132503513f97774e4fddc650064b0262b771170",
    "GPL-2.0 (terms)": "9874e4266f010abb577451f2573e333f5b02d45418605edc887f8ab670d29020",
    "GPL-3.0": "9e503558a0e7b087b4aa1a8a1a5bb26d53eb67f13185f34ba9287b50bf3836f6",
    "GPL-3.0 (terms)": "842fccbaaaa15a4e6a2b744f7be5205435cc2d3cb8d13e79f46edbe79a3369e2",
    "LGPL-2.0": "aef436a7f4191ac8b59ae18aa53a4bd9d10915f143ce22b420ef6d7a07d029ad",
    "LGPL-2.0 (terms)": "8516ce142c8a6c4984aea0c29f68bb3b7c3e0ab4a1e0df66e9650cd5004d7ca1",
    "LGPL-2.1": "73f8771023a7bd97f99604cee25be5ea96b506e8a15023953726f00bcf5e8cf9",
    "LGPL-2.1 (terms)": "4c0e31071a3387f7e9a25974f05a970bc237220ca37b4f43dc9a1103959048aa",
    "LGPL-3.0": "91b5d3e9e307d305f7c91670699dcefa38a95bc0127f171027869fadcae9f986",
    "MPL-1.1": "2310bdec6e3c493fcf4e10b3eb0a9e1271da2198b169bc489c0f276295eee647",
    "MPL-2.0": "bfe9951ed22e5ad9a4d9ec4866d915e6cc1eb1a24de92826e6537df388dce289",
    "Unlicense": "788cc8843bf483eb3ea3b5f6c317b95502da6e7105963f7c57c872ceb263fd49",
}
