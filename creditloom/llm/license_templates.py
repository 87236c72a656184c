"""Templates of the license scan: whole texts, headers, and notices made from names by a rule.

Whole texts stand in ``license_texts``, one file per license, whose name is the license's.
"""

from __future__ import annotations

from pathlib import Path

TEXTS = Path(__file__).parent / "license_texts"

#: Sentences and headers by which a license is applied, under its identifier.
SENTENCES = [
    ("all-rights-reserved", "All rights reserved."),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at",
    ),
    (
        "apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions "
        "and limitations under the License.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
    ),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the Software without restriction",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy "
        "of the MPL was not distributed with this file, You can obtain one at",
    ),
    (
        "mpl-1.1",
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the "
        "\"License\"); you may not use this file except in compliance with the License.",
    ),
    (
        "epl-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse "
        "Public License 2.0 which is available at",
    ),
    (
        "epl-1.0",
        "All rights reserved. This program and the accompanying materials are made available under the "
        "terms of the Eclipse Public License v1.0 which accompanies this distribution",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
    ),
    (
        "0bsd",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES",
    ),
    (
        "cc0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or "
        "neighboring rights to this work.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation",
    ),
]

#: The family's name, its identifier, its versions.
GNU = [
    ("GNU General Public License", "gpl", ["2", "3"]),
    ("GNU Lesser General Public License", "lgpl", ["2.1", "3"]),
    ("GNU Library General Public License", "lgpl", ["2"]),
    ("GNU Affero General Public License", "agpl", ["3"]),
]

#: Names by which notices call a license, under its identifier.
NAMES = {
    "0bsd": ["0BSD license"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0 license"],
    "artistic-2.0": ["Artistic License 2.0"],
    "bsd-2-clause": ["BSD 2-Clause license", "2-clause BSD license", "Simplified BSD License"],
    "bsd-3-clause": ["BSD 3-Clause license", "3-clause BSD license", "New BSD License", "Modified BSD License"],
    "bsl-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "cc-by-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International"],
    "cc-by-nc-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International"],
    "cc-by-nd-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International"],
    "cc-by-sa-3.0": ["CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0"],
    "cc-by-sa-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International"],
    "cc-by-nc-sa-4.0": [
        "CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International",
    ],
    "cc0-1.0": ["CC0 1.0 Universal", "Creative Commons CC0 1.0", "Creative Commons Zero v1.0"],
    "epl-1.0": ["Eclipse Public License v1.0", "Eclipse Public License 1.0"],
    "epl-2.0": ["Eclipse Public License v2.0", "Eclipse Public License 2.0"],
    "isc": ["ISC License", "ISC Licence"],
    "mit": ["MIT License", "MIT Licence", "X11 License", "Expat License"],
    "mpl-1.1": ["Mozilla Public License Version 1.1", "Mozilla Public License 1.1"],
    "mpl-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0", "Mozilla Public License 2.0"],
    "unlicense": ["Unlicense license"],
    "wtfpl": ["Do What The Fuck You Want To Public License"],
    "zlib": ["zlib License", "zlib/libpng License"],
}


def _notices() -> list[tuple[str, str]]:
    """``under [the] <name>`` for each name, and the tag that files carry."""
    named = [(key, name) for key, names in NAMES.items() for name in names]
    tags = [(key, key) for key in NAMES]
    headers = []
    for family, short, versions in GNU:
        for v in versions:
            key = f"{short}-{v if '.' in v else v + '.0'}"
            calls = [f"{family}, version {v}", f"{family} v{v}", f"GNU {short} v{v}", f"GNU {short} version {v}"]
            calls += [f"{family} version {v}.0", f"{short}v{v}", f"{short}-{v}"] if "." not in v else []
            named += [(key, x) for x in calls]
            tags += [(key, f"{key}{suffix}") for suffix in ("", "-only", "-or-later")]
            headers.append(
                (
                    key,
                    f"under the terms of the {family} as published by the Free Software Foundation; "
                    f"either version {v} of the License, or (at your option) any later version.",
                )
            )
    return (
        [(key, f"under {the}{name}") for key, name in named for the in ("", "the ")]
        + [(key, f"SPDX-License-Identifier: {tag}") for key, tag in tags]
        + headers
    )


def templates() -> list[tuple[str, str]]:
    """(license, text) of every template; a license has several."""
    whole = [(f.stem, f.read_text(encoding="utf-8")) for f in sorted(TEXTS.glob("*.txt"))]
    return SENTENCES + _notices() + whole
