"""Whole texts of short public licenses, and the notices that longer ones tell authors to use, as published;
names and years left out. Whole texts of long licenses lie in ``license_texts``, as published too. The AGPL has none:
only its notice is met."""

from importlib.resources import files

TEMPLATES = {
    "MIT": """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
notice and this permission notice shall be included in all copies or substantial portions of the Software. THE
SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
    "ISC": """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.
""",
    "BSD-2-Clause": """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
""",
    "BSD-3-Clause": """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
""",
    "Zlib": """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the
original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being
the original software. This notice may not be removed or altered from any source distribution.
""",
    "Unlicense": """
This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication
for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to
be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please
refer to http://unlicense.org
""",
    "Apache-2.0": """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.
""",
    "GPL-3.0-or-later": """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details. You should have received a copy of the GNU General Public License along with this program.
""",
    "MPL-2.0": """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.
""",
    "notice: MIT": "Released under the MIT License.",
    "notice: BSD": "Released under the BSD License.",
    "notice: Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice: GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "notice: GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice: LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "notice: AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "notice: MPL-2.0": "Licensed under the Mozilla Public License, version 2.0.",
    "notice: CC-BY-4.0": "Licensed under CC BY 4.0.",
    "notice: CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "notice: CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "notice: CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "notice: CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "GPL-2.0-or-later": """
This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for
more details. You should have received a copy of the GNU General Public License along with this program.
""",
    "LGPL-2.1-or-later": """
This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for
more details. You should have received a copy of the GNU Lesser General Public License along with this library.
""",
    "LGPL-3.0-or-later": """
This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for
more details. You should have received a copy of the GNU Lesser General Public License along with this program.
""",
    "AGPL-3.0-or-later": """
This program is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General Public
License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for
more details. You should have received a copy of the GNU Affero General Public License along with this program.
""",
    "notice: Apache": "Released under the Apache License.",
    "notice: GPL": "Released under the GNU General Public License.",
    "notice: LGPL": "Released under the GNU Lesser General Public License.",
    "notice: AGPL": "Released under the GNU Affero General Public License.",
    "notice: LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "notice: CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "notice: CC0-1.0": "Licensed under CC0 1.0.",
}

#: Whole texts of long licenses, named by their files.
TEMPLATES |= {f"text: {f.name.removesuffix('.txt')}": f.read_text() for f in sorted((files("kbspark.llm") / "license_texts").iterdir(), key=lambda f: f.name)}

_GPL = ("lesser", "library", "affero")
#: (phrases that a stretch must hold, words that it must not hold) of the templates that others resemble.
TELLING = {
    "text: Apache-2.0": (("apache license version 2 0",), ()),
    "text: CC0-1.0": (("cc0 1 0 universal",), ()),
    "text: GPL-2.0": (("gnu general public license version 2 june 1991",), ()),
    "text: GPL-3.0": (("gnu general public license version 3 29 june 2007",), ()),
    "text: LGPL-2.1": (("gnu lesser general public license version 2 1 february 1999",), ()),
    "text: LGPL-3.0": (("gnu lesser general public license version 3 29 june 2007",), ()),
    "text: MPL-2.0": (("mozilla public license version 2 0",), ()),
    "BSD-3-Clause": (("endorse",), ()),
    "Apache-2.0": (("apache", "2 0"), ()),
    "MPL-2.0": (("mozilla", "2 0"), ()),
    "GPL-2.0-or-later": (("general public license", "version 2 of"), _GPL),
    "GPL-3.0-or-later": (("general public license", "version 3"), _GPL),
    "LGPL-2.1-or-later": (("lesser general public license", "version 2 1"), ()),
    "LGPL-3.0-or-later": (("lesser general public license", "version 3"), ()),
    "AGPL-3.0-or-later": (("affero general public license", "version 3"), ()),
    "notice: MIT": (("mit",), ()),
    "notice: BSD": (("bsd",), ()),
    "notice: Apache": (("apache",), ()),
    "notice: Apache-2.0": (("apache", "2 0"), ()),
    "notice: GPL": (("general public license",), _GPL),
    "notice: GPL-2.0": (("general public license", "version 2"), _GPL),
    "notice: GPL-3.0": (("general public license", "version 3"), _GPL),
    "notice: LGPL": (("lesser general public license",), ()),
    "notice: LGPL-2.1": (("lesser general public license", "version 2 1"), ()),
    "notice: LGPL-3.0": (("lesser general public license", "version 3"), ()),
    "notice: AGPL": (("affero general public license",), ()),
    "notice: AGPL-3.0": (("affero general public license", "version 3"), ()),
    "notice: MPL-2.0": (("mozilla", "2 0"), ()),
    "notice: CC-BY-4.0": (("cc by 4 0",), ()),
    "notice: CC-BY-SA-4.0": (("cc by sa 4 0",), ()),
    "notice: CC-BY-ND-4.0": (("cc by nd 4 0",), ()),
    "notice: CC-BY-NC-4.0": (("cc by nc 4 0",), ()),
    "notice: CC-BY-NC-SA-4.0": (("cc by nc sa 4 0",), ()),
    "notice: CC-BY-NC-ND-4.0": (("cc by nc nd 4 0",), ()),
    "notice: CC0-1.0": (("cc0 1 0",), ()),
}
