"""Base phrases, texts of licences and their notices with the phrase that each must have, identifiers."""

#: Fixed base phrases and their labels.
BASE_PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Fixed texts of the method: label, text, mandatory key phrase (words that stand in the text).
TEMPLATES = [
    ("lgpl", "GNU Lesser General Public License", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License", "GNU Affero General Public License"),
    ("epl", "Eclipse Public License", "Eclipse Public License"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike", "Attribution-ShareAlike"),
    ("cc-by", "Creative Commons Attribution", "Creative Commons Attribution"),
    ("cc0", "Creative Commons Zero", "Creative Commons Zero"),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation""",
        "GNU General Public License",
    ),
    (
        "gpl",
        """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for
        more details.""",
        "GNU General Public License",
    ),
    (
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at""",
        "Apache License",
    ),
    (
        "apache",
        """Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
        "software distributed under the License",
    ),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software""",
        "Permission is hereby granted, free of charge",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met""",
        "Redistribution and use in source and binary forms",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
        "Permission to use, copy, modify",
    ),
    (
        "mpl",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at""",
        "Mozilla Public License",
    ),
    ("mpl", "subject to the terms of the Mozilla Public License", "Mozilla Public License"),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
        held liable for any damages arising from the use of this software.""",
        "In no event will the authors be held liable",
    ),
    (
        "bsl",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
        and accompanying documentation covered by this license""",
        "any person or organization obtaining a copy",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software""",
        "free and unencumbered software",
    ),
    (
        "bsd",
        """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.""",
        "may be used to endorse or promote products derived from this software",
    ),
    (
        "mit",
        """The above copyright notice and this permission notice shall be included in all copies or substantial portions
        of the Software.""",
        "shall be included in all copies or substantial portions of the Software",
    ),
    (
        "lgpl",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation""",
        "GNU Lesser General Public License",
    ),
    (
        "cc-by",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Creative Commons Attribution",
    ),
    ("cddl", "Common Development and Distribution License", "Common Development and Distribution License"),
    ("eupl", "European Union Public Licence", "European Union Public Licence"),
]

#: Fixed identifiers of licences, as a line with SPDX-License-Identifier states them, and their labels.
IDENTIFIERS = [
    ("0BSD", "bsd"),
    ("AGPL-3.0", "agpl"),
    ("Apache-1.1", "apache"),
    ("Apache-2.0", "apache"),
    ("BSD-2-Clause", "bsd"),
    ("BSD-3-Clause", "bsd"),
    ("BSL-1.0", "bsl"),
    ("CC-BY-3.0", "cc-by"),
    ("CC-BY-4.0", "cc-by"),
    ("CC-BY-SA-3.0", "cc-by-sa"),
    ("CC-BY-SA-4.0", "cc-by-sa"),
    ("CC0-1.0", "cc0"),
    ("CDDL-1.0", "cddl"),
    ("EPL-1.0", "epl"),
    ("EPL-2.0", "epl"),
    ("EUPL-1.2", "eupl"),
    ("GPL-2.0", "gpl"),
    ("GPL-3.0", "gpl"),
    ("ISC", "isc"),
    ("LGPL-2.1", "lgpl"),
    ("LGPL-3.0", "lgpl"),
    ("MIT", "mit"),
    ("MPL-1.1", "mpl"),
    ("MPL-2.0", "mpl"),
    ("Unlicense", "unlicense"),
    ("Zlib", "zlib"),
]
