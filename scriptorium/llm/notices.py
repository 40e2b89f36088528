"""Notices of licence families: headers, short forms and opening paragraphs in their common public wording."""

#: What an author puts into a work to place it under a licence.
NOTICES = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPL.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
    ),
    "artistic": (
        "This is free software; you can redistribute it and/or modify it under the same terms as the Perl programming language system itself.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License.",
        "Licensed under the Artistic License 2.0.",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE or copy at http://www.boost.org/LICENSE_1_0.txt",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software",
        "Licensed under the Boost Software License.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Distributed under the BSD 3-Clause License.",
        "Released under the BSD license.",
    ),
    "cc-by": (
        "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
        "Licensed under CC BY 4.0.",
    ),
    "cc-by-nc": (
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
        "Licensed under CC BY-NC 4.0.",
    ),
    "cc-by-nc-sa": (
        "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ),
    "cc-by-nd": (
        "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-ND 4.0.",
    ),
    "cc-by-sa": (
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal dedication.",
        "Released under CC0 1.0.",
    ),
    "cddl": (
        "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License.",
        "Licensed under the CDDL.",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-2.0",
        "Licensed under the Eclipse Public License.",
    ),
    "eupl": (
        "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the Licence); You may not use this work except in compliance with the Licence.",
        "Licensed under the European Union Public Licence.",
    ),
    "gfdl": (
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
        "Licensed under the GNU Free Documentation License.",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/",
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GPL.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the LGPL.",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License.",
    ),
    "ms-pl": (
        "This source code is subject to terms and conditions of the Microsoft Public License. A copy of the license can be found in the License file at the root of this distribution.",
        "Licensed under the Microsoft Public License.",
    ),
    "odbl": (
        "This database is made available under the Open Database License: http://opendatacommons.org/licenses/odbl/1.0/. Any rights in individual contents of the database are licensed under the Database Contents License.",
        "Licensed under the Open Database License.",
    ),
    "ofl": (
        "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at http://scripts.sil.org/OFL",
        "Licensed under the SIL Open Font License.",
    ),
    "postgresql": (
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
        "Licensed under the PostgreSQL License.",
    ),
    "proprietary": (
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, without the prior written permission of the publisher.",
        "This software is confidential and proprietary information. You shall not disclose such confidential information and shall use it only in accordance with the terms of the license agreement you entered into.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "All rights reserved.",
    ),
    "psf": (
        "This LICENSE AGREEMENT is between the Python Software Foundation (PSF), and the Individual or Organization (Licensee) accessing and otherwise using this software in source or binary form and its associated documentation.",
        "Licensed under the Python Software Foundation License.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "Released under the Unlicense.",
    ),
    "wtfpl": (
        "This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as published by Sam Hocevar.",
        "Licensed under the WTFPL.",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        "Licensed under the zlib License.",
    ),
}
#: SPDX identifiers of the families, which stand after "SPDX-License-Identifier:".
SPDX = {
    "agpl": ("AGPL-3.0-only", "AGPL-3.0-or-later"), "apache": ("Apache-2.0",), "artistic": ("Artistic-2.0",), "boost": ("BSL-1.0",), "bsd": ("BSD-3-Clause",),
    "cc-by": ("CC-BY-4.0",), "cc-by-nc": ("CC-BY-NC-4.0",), "cc-by-nc-sa": ("CC-BY-NC-SA-4.0",), "cc-by-nd": ("CC-BY-ND-4.0",), "cc-by-sa": ("CC-BY-SA-4.0",), "cc0": ("CC0-1.0",),
    "cddl": ("CDDL-1.1",), "epl": ("EPL-2.0",), "eupl": ("EUPL-1.2",), "gfdl": ("GFDL-1.3-or-later",), "gpl": ("GPL-3.0-only", "GPL-2.0-or-later"), "isc": ("ISC",), "lgpl": ("LGPL-2.1-only", "LGPL-3.0-or-later"),
    "mit": ("MIT",), "mpl": ("MPL-2.0",), "ms-pl": ("MS-PL",), "odbl": ("ODbL-1.0",), "ofl": ("OFL-1.1",), "postgresql": ("PostgreSQL",), "psf": ("PSF-2.0",), "unlicense": ("Unlicense",), "wtfpl": ("WTFPL",), "zlib": ("Zlib",),
}
