"""Wording of licences and notices, and the sentences and ordered rules that follow from it."""

from __future__ import annotations

import re

#: Sentences end at full stops, question or exclamation marks, colons or semicolons after a word and before white space, at blank lines (lines of marks
#: alone count as blank, so comment leaders do), after a closing row of stars or dashes, and before a numbered or lettered item at the
#: start of a line. A single line break is a space. Possessive: long runs of marks or spaces cost no more than their length.
SENTENCE_END = (
    r"""(?<=[^ \t\n\r\f\x0B.?!:;])[.?!:;]++["')\]]*+[ \t\n\r\f\x0B]++(?:\(?(?:[0-9]{1,2}|[A-Za-z])[.)][ \t]++)?"""
    r"""|\n[ \t\r\f\x0B!-/:-@\[-`{-~]*+\n"""
    r"""|(?<![*=#_~-])[*=#_~-]{3,}+[ \t\r]*+\n"""
    r"""|\n[ \t#*/;%>|!-]*+\(?(?:[0-9]{1,2}|[A-Za-z])[.)][ \t]++"""
)
#: What an identifier line becomes before the text is cut, so that its colon ends nothing.
SPDX, SPDX_SENTENCE = "SPDX-License-Identifier:", "\n\nspdx "
#: A pattern's sentence is found by so many first words.
KEY_WORDS = 3

#: Official wording. <...> stands for any words.
NOTICES = [
    ("Apache-2.0", """Apache License
Version 2.0, January 2004
http://www.apache.org/licenses/

TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License."""),
    ("Apache-2.0", """The ASF licenses this file to You under the Apache License, Version 2.0
(the "License"); you may not use this file except in compliance with the License."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""),
    ("JSON", """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

The Software shall be used for Good, not Evil.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""),
    ("X11", """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.

Except as contained in this notice, the name<more>"""),
    ("MIT-0", """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""),
    ("NCSA", """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
with the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimers."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""),
    ("ISC", """Permission to use, copy, modify, and distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND <holder> DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS."""),
    ("curl", """Permission to use, copy, modify, and distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT OF THIRD PARTY RIGHTS."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of <holder> nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. The name of <holder> may not be used to endorse or promote products
   derived from this software without specific prior written permission."""),
    ("BSD-4-Clause", """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement:

4. Neither the name of <holder> nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""),
    ("Zlib", """Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software."""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:"""),
    ("Unlicense", """This is free and unencumbered software released into the public domain."""),
    ("WTFPL", """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION"""),
    ("Beerware", """As long as you retain this notice you can do whatever you want with this stuff."""),
    ("PostgreSQL", """Permission to use, copy, modify, and distribute this software and its
documentation for any purpose, without fee, and without a written agreement
is hereby granted, provided that the above copyright notice and this
paragraph and the following two paragraphs appear in all copies."""),
    ("HPND", """Permission to use, copy, modify, and distribute this software and its
documentation for any purpose and without fee is hereby granted, provided
that the above copyright notice appear in all copies and that both that
copyright notice and this permission notice appear in supporting documentation<more>"""),
    ("Python-2.0", """PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2

1. This LICENSE AGREEMENT is between the Python Software Foundation
("PSF"), and the Individual or Organization ("Licensee") accessing and
otherwise using this software ("Python") in source or binary form and
its associated documentation."""),
    ("OpenSSL", """Redistributions of any form whatsoever must retain the following acknowledgment:

"This product includes software developed by the OpenSSL Project
for use in the OpenSSL Toolkit (http://www.openssl.org/)"<more>"""),
    ("GPL-1.0", """GNU GENERAL PUBLIC LICENSE
Version 1, February 1989"""),
    ("GPL-1.0-or-later", """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 1, or (at your option)
any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""),
    ("GPL-2.0", """GNU GENERAL PUBLIC LICENSE
Version 2, June 1991"""),
    ("GPL-2.0-or-later", """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""),
    ("GPL-2.0-only", """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation."""),
    ("GPL-3.0", """GNU GENERAL PUBLIC LICENSE
Version 3, 29 June 2007"""),
    ("GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""),
    ("GPL-3.0-only", """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, version 3<more>

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""),
    ("LGPL-2.0", """GNU LIBRARY GENERAL PUBLIC LICENSE
Version 2, June 1991"""),
    ("LGPL-2.0-or-later", """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Library General Public
License as published by the Free Software Foundation; either
version 2 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Library General Public License for more details."""),
    ("LGPL-2.1", """GNU LESSER GENERAL PUBLIC LICENSE
Version 2.1, February 1999"""),
    ("LGPL-2.1-or-later", """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details."""),
    ("LGPL-3.0", """GNU LESSER GENERAL PUBLIC LICENSE
Version 3, 29 June 2007"""),
    ("LGPL-3.0-or-later", """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 3 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details."""),
    ("AGPL-3.0", """GNU AFFERO GENERAL PUBLIC LICENSE
Version 3, 19 November 2007"""),
    ("AGPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU Affero General Public License for more details."""),
    ("GFDL-1.2-or-later", """Permission is granted to copy, distribute and/or modify this document
under the terms of the GNU Free Documentation License, Version 1.2
or any later version published by the Free Software Foundation;"""),
    ("GFDL-1.3-or-later", """Permission is granted to copy, distribute and/or modify this document
under the terms of the GNU Free Documentation License, Version 1.3
or any later version published by the Free Software Foundation;"""),
    ("MPL-1.1", """MOZILLA PUBLIC LICENSE
Version 1.1"""),
    ("MPL-1.1", """The contents of this file are subject to the Mozilla Public License
Version 1.1 (the "License"); you may not use this file except in
compliance with the License."""),
    ("MPL-1.1", """The contents of this file are subject to the Mozilla Public License
Version 1.1 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

https://www.mozilla.org/MPL/

All Rights Reserved."""),
    ("MPL-2.0", """Mozilla Public License Version 2.0"""),
    ("MPL-2.0", """Mozilla Public License, version 2.0"""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http<address>mozilla.org/MPL/2.0/."""),
    ("EPL-1.0", """All rights reserved. This program and the accompanying materials
are made available under the terms of the Eclipse Public License v1.0
which accompanies this distribution, and is available at
http://www.eclipse.org/legal/epl-v10.html"""),
    ("EPL-2.0", """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0"""),
    ("CDDL-1.0", """The contents of this file are subject to the terms of the
Common Development and Distribution License (the "License")."""),
    ("OFL-1.1", """This Font Software is licensed under the SIL Open Font License, Version 1.1."""),
    ("Artistic-1.0", """The intent of this document is to state the conditions under which a
Package may be copied, such that the Copyright Holder maintains some
semblance of artistic control over the development of the package,
while giving the users of the package the right to use and distribute
the Package in a more-or-less customary fashion, plus the right to make
reasonable modifications."""),
    ("Artistic-2.0", """This license establishes the terms under which a given free software Package
may be copied, modified, distributed, and/or redistributed."""),
    ("EUPL-1.2", """Licensed under the EUPL, Version 1.2 <more>"""),
    ("CC0-1.0", """Creative Commons Legal Code

CC0 1.0 Universal"""),
]

#: Licence, then sentences that name it alone, normalised.
TAGS = [
    ("Apache-2.0", "licensed under the apache license version 2 0", "released under the apache license version 2 0"),
    ("MIT", "released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "the mit license mit", "mit license"),
    ("BSD-3-Clause", "licensed under the bsd 3 clause license", "bsd 3 clause license"),
    ("BSD-2-Clause", "licensed under the bsd 2 clause license", "bsd 2 clause license"),
    ("GPL-2.0", "this work is licensed under the gnu general public license version 2"),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    ("MPL-2.0", "licensed under the mozilla public license version 2 0"),
    ("CC0-1.0", "this work is dedicated to the public domain under cc0 1 0", "dedicated to the public domain under cc0 1 0"),
    ("Proprietary", "all rights reserved"),
]
#: Creative Commons licences: parts of the short name, and their words.
_CC_PARTS = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}
_CC_KINDS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")


def normalised(sentence: str) -> str:
    """Lower-cased, every run of other characters than a-z and 0-9 as one space; ``<...>`` as a star."""
    words = re.sub(r"<[^>]*>", "\1", sentence).lower()
    return re.sub(r"[^a-z0-9\1]+", " ", words).strip().replace("\1", "*")


def sentences_of(text: str) -> list[str]:
    """The normalised sentences of a wording, blank ones left out; those of under three words say nothing by themselves."""
    found = [normalised(x) for x in re.split(SENTENCE_END, text.replace(SPDX, SPDX_SENTENCE))]
    return [x for x in found if len(x.split()) >= KEY_WORDS]


def _wordings() -> list[tuple[str, list[str]]]:
    out = [(licence, sentences_of(text)) for licence, text in NOTICES]
    out += [(licence, [sentence]) for licence, *sentences in TAGS for sentence in sentences]
    for kind in _CC_KINDS:
        long = " ".join(_CC_PARTS[p] for p in kind.split())
        for version, suffix in (("4 0", "international"), ("3 0", "unported")):
            name = f"CC-{kind.upper().replace(' ', '-')}-{version.replace(' ', '.')}"
            out += [(name, [s]) for s in (f"licensed under cc {kind} {version}", f"this work is licensed under a creative commons {long} {version} {suffix} license")]
    names = dict.fromkeys(licence for licence, _ in out if licence != "Proprietary")
    return out + [(name, [f"spdx {normalised(name)}"]) for name in names]


def sentence_rules() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """Identifiers of sentences (``s1`` on, one for each wording) with their patterns, and the ordered rules over them.

    A full text of the GPL family ends with the notice it advises; that belongs to the text, so the rule of a title is
    also given together with the notice. "All rights reserved" before a licence's own sentences belongs to its copyright line.
    """
    ids: dict[str, str] = {}
    rules = [(licence, [ids.setdefault(s, f"s{len(ids) + 1}") for s in sentences]) for licence, sentences in _wordings()]
    reserved = ids["all rights reserved"]
    titles = {ids[x] for x in ids if re.match(r"gnu .*license version", x)}
    notices = {licence: seq for licence, seq in rules if licence.endswith("-or-later") and len(seq) > 1}
    rules += [(licence, seq + notices[f"{licence}-or-later"]) for licence, seq in rules if seq[0] in titles and f"{licence}-or-later" in notices]
    rules += [(licence, [reserved, *seq]) for licence, seq in rules if len(seq) > 1 and seq[0] != reserved]
    return {v: k for k, v in ids.items()}, rules


SENTENCES, RULES = sentence_rules()
