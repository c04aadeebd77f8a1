"""Licence notices as passages for the license scan.

Fixed values: the wording of public licence notices, in words. A passage is (label, words, key
phrases); a file that holds a passage must have one of its key phrases in place. A notice of
several sentences gives several passages, and a passage that could miss a key phrase by one
changed word names two phrases that share no word.
"""

from __future__ import annotations

_GNU = (
    ("gpl", "program", "gnu general public license", ("the gnu general public license",)),
    ("lgpl", "library", "gnu lesser general public license", ("gnu lesser general public", "lesser general public license")),
    ("agpl", "program", "gnu affero general public license", ("gnu affero general public", "affero general public license")),
)


def _gnu() -> list[tuple[str, str, tuple[str, ...]]]:
    out = []
    for label, work, name, keys in _GNU:
        out += [
            (label, f"this {work} is free software you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation either version 3 of the license or at your option any later version", keys),
            (label, f"this {work} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the {name} for more details", keys),
            (label, f"you should have received a copy of the {name} along with this {work} if not see https www gnu org licenses", keys),
            (label, f"this work is licensed under the {name} version 3", keys),
        ]
    return out


PASSAGES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    *_gnu(),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license", "this file except in compliance")),
    ("apache", "you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses",)),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("unless required by applicable law", "as is basis without warranties")),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("hereby granted free of charge", "any person obtaining a copy")),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", ("hereby granted free of charge", "to deal in the software without restriction", "merge publish distribute sublicense")),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("this permission notice shall be", "copies or substantial portions")),
    ("mit", "released under the mit license", ("mit license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("copy modify and or distribute this", "permission notice appear in all copies")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "that the following conditions are met")),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code", "this list of conditions")),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions in binary form", "or other materials provided")),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("neither the name of the", "endorse or promote products")),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", ("mozilla public license", "mozilla org mpl")),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", ("eclipse public license", "eclipse org legal")),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors", "arising from the use of this")),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", ("must not be misrepresented", "claim that you wrote")),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("any person or organization obtaining", "accompanying documentation covered by")),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("extent possible under law", "related or neighboring rights")),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "into the public domain")),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("publish use compile sell", "as a compiled binary")),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("attribution sharealike",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial 4 0",)),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", ("attribution noderivatives 4 0",)),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", ("attribution noncommercial sharealike",)),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license", ("attribution noncommercial noderivatives",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    *((f"cc-by-{x.replace(' ', '-')}", f"cc by {x} 4 0", (f"cc by {x} 4",)) for x in ("nc", "sa", "nd", "nc sa", "nc nd")),
)

#: Spellings that count as one word.
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "organisation": "organization", "neighbouring": "neighboring", "http": "https"}
