"""License signatures (operator 3), written by hand: one a line, as label, priority, confidence, keywords, pattern.

A pattern is a regular expression over words in lower case that are joined by single spaces. Keywords gate it: of the
alternatives, which are separated by commas, one must have all its words (joined by +) in the text. Higher priorities win;
of equal ones the earlier line. {L} is license in its spellings, {U} the ways to say that something is licensed under
what follows, {V} an optional word before a version, {N} a few words of any kind.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

PARTS = {
    "{L}": "licen[cs]es?",
    "{U}": "(?:licen[cs]ed|released|distributed|available|published|provided|offered|redistributed|governed|covered) (?:under|by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?",
    "{V}": "(?:version |v ?)?",
    "{N}": "(?:[a-z0-9]+ ){0,9}",
}

#: Phrases that always count, and their labels. Their rules have priority 35 and confidence 0.9.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

TABLE = r"""
# identifiers
mit                   50 1.00 spdx+mit                        spdx {L} identifier mit
mit-0                 51 1.00 spdx+mit                        spdx {L} identifier mit 0
apache-1.1            50 1.00 spdx+apache                     spdx {L} identifier apache 1 1
apache-2              50 1.00 spdx+apache                     spdx {L} identifier apache 2 0
bsd-1-clause          50 1.00 spdx+bsd                        spdx {L} identifier bsd 1 clause
bsd-2-clause          50 1.00 spdx+bsd                        spdx {L} identifier bsd 2 clause
bsd-3-clause          50 1.00 spdx+bsd                        spdx {L} identifier bsd 3 clause
bsd-4-clause          50 1.00 spdx+bsd                        spdx {L} identifier bsd 4 clause
0bsd                  50 1.00 spdx+0bsd                       spdx {L} identifier 0bsd
gpl-1                 50 1.00 spdx+gpl                        spdx {L} identifier gpl 1 0(?: only)?
gpl-2                 50 1.00 spdx+gpl                        spdx {L} identifier gpl 2 0(?: only)?
gpl-2-or-later        51 1.00 spdx+gpl                        spdx {L} identifier gpl 2 0 or later
gpl-3                 50 1.00 spdx+gpl                        spdx {L} identifier gpl 3 0(?: only)?
gpl-3-or-later        51 1.00 spdx+gpl                        spdx {L} identifier gpl 3 0 or later
lgpl-2                50 1.00 spdx+lgpl                       spdx {L} identifier lgpl 2 0(?: only| or later)?
lgpl-2.1              50 1.00 spdx+lgpl                       spdx {L} identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later     51 1.00 spdx+lgpl                       spdx {L} identifier lgpl 2 1 or later
lgpl-3                50 1.00 spdx+lgpl                       spdx {L} identifier lgpl 3 0(?: only)?
lgpl-3-or-later       51 1.00 spdx+lgpl                       spdx {L} identifier lgpl 3 0 or later
agpl-3                50 1.00 spdx+agpl                       spdx {L} identifier agpl 3 0(?: only)?
agpl-3-or-later       51 1.00 spdx+agpl                       spdx {L} identifier agpl 3 0 or later
mpl-1.1               50 1.00 spdx+mpl                        spdx {L} identifier mpl 1 1
mpl-2                 50 1.00 spdx+mpl                        spdx {L} identifier mpl 2 0(?: no copyleft exception)?
epl-1                 50 1.00 spdx+epl                        spdx {L} identifier epl 1 0
epl-2                 50 1.00 spdx+epl                        spdx {L} identifier epl 2 0
cddl-1                50 1.00 spdx+cddl                       spdx {L} identifier cddl 1 [01]
isc                   50 1.00 spdx+isc                        spdx {L} identifier isc
zlib                  50 1.00 spdx+zlib                       spdx {L} identifier zlib
unlicense             50 1.00 spdx+unlicense                  spdx {L} identifier unlicense
wtfpl                 50 1.00 spdx+wtfpl                      spdx {L} identifier wtfpl
bsl-1                 50 1.00 spdx+bsl                        spdx {L} identifier bsl 1 0
busl-1.1              50 1.00 spdx+busl                       spdx {L} identifier busl 1 1
artistic-2            50 1.00 spdx+artistic                   spdx {L} identifier artistic 2 0
eupl-1.2              50 1.00 spdx+eupl                       spdx {L} identifier eupl 1 2
ofl-1.1               50 1.00 spdx+ofl                        spdx {L} identifier ofl 1 1
cc0-1                 50 1.00 spdx+cc0                        spdx {L} identifier cc0 1 0
cc-by                 50 1.00 spdx+cc                         spdx {L} identifier cc by [1-4] 0
cc-by-sa              50 1.00 spdx+cc                         spdx {L} identifier cc by sa [1-4] 0
cc-by-nc              50 1.00 spdx+cc                         spdx {L} identifier cc by nc [1-4] 0
cc-by-nc-sa           50 1.00 spdx+cc                         spdx {L} identifier cc by nc sa [1-4] 0
cc-by-nc-nd           50 1.00 spdx+cc                         spdx {L} identifier cc by nc nd [1-4] 0
cc-by-nd              50 1.00 spdx+cc                         spdx {L} identifier cc by nd [1-4] 0
# the licenses' own words
mit                   45 1.00 hereby+granted+copy             permission is hereby granted free of charge to any person obtaining a copy
mit                   44 0.95 notice+substantial              the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-advertising       46 1.00 hereby+advertising              permission is hereby granted free of charge {N}all advertising materials mentioning
x11                   46 1.00 consortium                      except as contained in this notice the name of the x consortium shall not be used
isc                   45 1.00 permission+fee+distribute       permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided
0bsd                  46 1.00 permission+fee+disclaims        permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims
ntp                   44 0.95 permission+fee                  permission to use copy modify and distribute this software and its documentation for any purpose (?:with or )?without fee is hereby granted provided that the above copyright notice appears?
bsd                   42 0.90 redistribution+binary           redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause          43 0.90 views+conclusions               the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies
bsd-3-clause          45 1.00 neither+contributors            neither the name of {N}nor the names of its contributors may be used to endorse or promote products
bsd-3-clause          44 0.95 endorse+derived                 names? of {N}may not be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause          46 1.00 advertising+mentioning          all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-patent            45 0.95 patent+bsd                      (?:bsd plus patent|bsd 2 clause plus patent) {L}
apache-2              45 1.00 compliance+obtain+apache        you may not use this file except in compliance with the {L} you may obtain a copy of the {L} at (?:https? )?(?:www )?apache org
apache-1.1            45 1.00 developed+apache                this product includes software developed by the apache software foundation
apache-2              44 0.95 perpetual+worldwide+grants      each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright {L}
gpl                   44 0.95 redistribute+gnu                you can redistribute it and or modify it under the terms of the gnu general public {L}
gpl-2-or-later        46 1.00 gnu+later                       gnu general public {L} as published by the free software foundation either {V}2(?: 0)? of the {L} or at your option any later version
gpl-3-or-later        46 1.00 gnu+later                       gnu general public {L} as published by the free software foundation either {V}3(?: 0)? of the {L} or at your option any later version
gpl-2                 45 1.00 gnu+foundation                  gnu general public {L} (?:{V}2(?: 0)? )?as published by the free software foundation(?: {V}2(?: 0)?)?
lgpl-2.1-or-later     46 1.00 lesser+later                    gnu lesser general public {L} as published by the free software foundation either {V}2 1 of the {L} or at your option any later version
lgpl-2-or-later       46 1.00 library+later                   gnu library general public {L} as published by the free software foundation either {V}2 of the {L} or at your option any later version
lgpl-3-or-later       46 1.00 lesser+later                    gnu lesser general public {L} as published by the free software foundation either {V}3(?: 0)? of the {L} or at your option any later version
agpl-3-or-later       46 1.00 affero+later                    gnu affero general public {L} as published by the free software foundation either {V}3(?: 0)? of the {L} or at your option any later version
gpl                   43 0.90 program+warranty+gnu            this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public {L}
mpl-2                 45 1.00 subject+mozilla                 this source code form is subject to the terms of the mozilla public {L} {V}2 0
mpl-1.1               45 1.00 contents+mozilla                the contents of this file are subject to the mozilla public {L} version 1 1
mpl-2                 44 0.95 incompatible+secondary          this source code form is incompatible with secondary licenses
epl-1                 45 1.00 accompanying+eclipse            this program and the accompanying materials are made available under the terms of the eclipse public {L} {V}1 0
epl-2                 45 1.00 accompanying+eclipse            this program and the accompanying materials are made available under the terms of the eclipse public {L} {V}2 0
cddl-1                45 1.00 contents+cddl,distribution+development  the contents of this file are subject to the terms of the (?:common development and distribution {L}|cddl)
unlicense             45 1.00 unencumbered                    this is free and unencumbered software released into the public domain
unlicense             44 0.95 anyone+compile                  anyone is free to copy modify publish use compile sell or distribute this software
wtfpl                 45 1.00 everyone+verbatim+fuck          everyone is permitted to copy and distribute verbatim or modified copies {N}you just do what the fuck you want to
zlib                  45 1.00 misrepresented                  the origin of this software must not be misrepresented
zlib                  44 0.95 altered+marked                  altered source versions must be plainly marked as such
bsl-1                 45 1.00 boost+software+distributed      distributed under the boost software {L} version 1 0
bsl-1                 44 0.95 obtaining+accompanying          any person or organization obtaining a copy of the software and accompanying documentation covered by this {L}
artistic-1            45 0.95 artistic+intent                 the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control
artistic-2            45 1.00 artistic+copyright              the artistic {L} 2 0 copyright
python-2              45 1.00 psf+licensee                    (?:the )?python software foundation psf and the individual or organization licensee
openssl               45 1.00 openssl+toolkit                 this product includes software developed by the openssl project for use in the openssl toolkit
ssleay                45 1.00 eric+young                      this product includes cryptographic software written by eric young
ncsa                  45 0.95 illinois+developed              developed by {N}university of illinois
curl                  45 1.00 daniel+stenberg                 copyright c {N}daniel stenberg
libpng                45 0.95 libpng+copyright                libpng versions {N}are copyright
ijg                   45 1.00 independent+jpeg                this software is based in part on the work of the independent jpeg group
freetype              45 1.00 freetype+portions               portions of this software are copyright {N}the freetype project
unicode               45 0.95 unicode+data+files              any person obtaining a copy of the unicode data files
icu                   45 0.95 international+machines          copyright c {N}international business machines corporation and others
json                  46 1.00 shall+evil                      the software shall be used for good not evil
beerware              45 1.00 beer+worth                      if we meet some day and you think this stuff is worth it you can buy me a beer
sqlite-blessing       45 1.00 blessing+disclaims              the author disclaims copyright to this source code in place of a legal notice here is a blessing
bzip2                 45 0.95 bzip2+seward                    this program bzip2 {N}copyright c {N}julian (?:r )?seward
ofl-1.1               45 1.00 reserved+font                   copyright c {N}with reserved font name
sspl-1                45 1.00 service+functionality           if you make the functionality of the program or a modified version available to third parties as a service
busl-1.1              45 1.00 business+change                 business source {L} {N}change date
elastic-2             45 1.00 hosted+managed                  you may not provide the software to third parties as a hosted or managed service
commons-clause        46 1.00 commons+clause                  commons clause (?:{L} )?condition
commons-clause        45 0.95 sell+grant                      the grant of rights under the {L} will not include and the {L} does not grant to you the right to sell the software
polyform-nc           45 1.00 polyform+noncommercial          polyform noncommercial {L}
polyform-strict       45 1.00 polyform+strict                 polyform strict {L}
polyform-small        45 1.00 polyform+small                  polyform small business {L}
cc0-1                 45 1.00 waived+related                  (?:has|have) waived all copyright and related or neighboring rights
cc-by                 44 0.95 creative+attribution            this work is licen[cs]ed under a creative commons attribution (?:[1-4] 0 )?(?:international |unported |generic )?{L}
cc-by-sa              45 1.00 creative+share,creative+sharealike  this work is licen[cs]ed under a creative commons attribution share ?alike (?:[1-4] 0 )?(?:international |unported |generic )?{L}
cc-by-nc              45 1.00 creative+commercial,creative+noncommercial  this work is licen[cs]ed under a creative commons attribution non ?commercial (?:[1-4] 0 )?(?:international |unported |generic )?{L}
gfdl                  45 1.00 documentation+permission        permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {L}
odbl-1                45 1.00 database+odbl,open+database     this {N}is made available under the open database {L}
ogl                   45 1.00 government+open                 contains public sector information licen[cs]ed under the open government {L}
# links to licenses
mit                   48 1.00 opensource+mit                  opensource org licenses mit(?: license)?(?: php)?
apache-2              48 1.00 apache+licenses                 apache org licenses license 2 0
bsd-2-clause          48 1.00 opensource+bsd                  opensource org licenses bsd 2 clause
bsd-3-clause          48 1.00 opensource+bsd                  opensource org licenses bsd 3 clause
gpl                   47 0.95 gnu+copyleft,gnu+licenses       gnu org (?:copyleft|licenses) gpl
gpl-2                 48 1.00 gnu+licenses                    gnu org licenses (?:old licenses )?gpl 2 0
gpl-3                 48 1.00 gnu+licenses                    gnu org licenses gpl 3 0
lgpl                  47 0.95 gnu+lgpl                        gnu org licenses lgpl
lgpl-2.1              48 1.00 gnu+lgpl                        gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3                48 1.00 gnu+lgpl                        gnu org licenses lgpl 3 0
agpl-3                48 1.00 gnu+agpl                        gnu org licenses agpl(?: 3 0)?
mpl-2                 48 1.00 mozilla+mpl                     mozilla org (?:en us )?mpl 2 0
epl-1                 48 1.00 eclipse+epl                     eclipse org legal epl v10
epl-2                 48 1.00 eclipse+epl                     eclipse org legal epl (?:2 0|v20)
bsl-1                 48 1.00 boost+license                   boost org license 1 0
unlicense             48 1.00 unlicense+org                   unlicense org
ofl-1.1               48 1.00 scripts+sil,sil+ofl             scripts sil org ofl
cc0-1                 48 1.00 creativecommons+zero            creativecommons org publicdomain zero 1 0
public-domain         48 1.00 creativecommons+mark            creativecommons org publicdomain mark 1 0
cc-by                 48 1.00 creativecommons+by              creativecommons org licenses by [1-4] [05]
cc-by-sa              48 1.00 creativecommons+sa              creativecommons org licenses by sa [1-4] [05]
cc-by-nc              48 1.00 creativecommons+nc              creativecommons org licenses by nc [1-4] [05]
cc-by-nc-sa           48 1.00 creativecommons+nc              creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd           48 1.00 creativecommons+nc              creativecommons org licenses by nc nd [1-4] [05]
cc-by-nd              48 1.00 creativecommons+nd              creativecommons org licenses by nd [1-4] [05]
# licensed under a name
mit                   40 1.00 mit                             {U}mit(?: x11| expat)?(?: {L})?
apache-1.1            41 1.00 apache                          {U}apache (?:software )?{L} {V}1 1
apache-2              40 1.00 apache                          {U}apache(?: software)?(?: {L})?(?: {V}2(?: 0)?)?
bsd-2-clause          41 1.00 bsd,freebsd                     {U}(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: {L})?
bsd-3-clause          41 1.00 bsd                             {U}(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: {L})?
bsd-4-clause          41 1.00 bsd                             {U}(?:bsd 4 clause|4 clause bsd|original bsd|old bsd)(?: {L})?
bsd                   40 0.90 bsd                             {U}bsd(?: {L})?
gpl-1                 41 1.00 gpl,general                       {U}(?:gnu )?(?:general public {L}|gpl) {V}1(?: 0)?
gpl-2                 41 1.00 gnu,gpl,general,gplv2           {U}(?:(?:gnu )?(?:general public {L}|gpl) {V}2(?: 0)?|gplv2)
gpl-3                 41 1.00 gnu,gpl,general,gplv3           {U}(?:(?:gnu )?(?:general public {L}|gpl) {V}3(?: 0)?|gplv3)
gpl                   40 0.90 gnu,gpl,general                 {U}(?:(?:gnu )?(?:general public {L}|gpl))
lgpl-2.1              41 1.00 lgpl,lesser,lgplv2              {U}(?:(?:gnu )?(?:lesser general public {L}|lgpl) {V}2 1|lgplv2(?: 1)?)
lgpl-3                41 1.00 lgpl,lesser,lgplv3              {U}(?:(?:gnu )?(?:lesser general public {L}|lgpl) {V}3(?: 0)?|lgplv3)
lgpl                  40 0.90 lgpl,lesser,library             {U}(?:gnu )?(?:(?:lesser|library) general public {L}|lgpl)
agpl-3                41 1.00 agpl,affero,agplv3              {U}(?:(?:gnu )?(?:affero general public {L}|agpl)(?: {V}3(?: 0)?)?|agplv3)
mpl-1.1               41 1.00 mpl,mozilla                     {U}(?:mozilla public {L}|mpl) {V}1 1
mpl-2                 40 1.00 mpl,mozilla                     {U}(?:mozilla public {L}|mpl)(?: {V}2(?: 0)?)?
epl-1                 41 1.00 epl,eclipse                     {U}(?:eclipse public {L}|epl) {V}1(?: 0)?
epl-2                 40 1.00 epl,eclipse                     {U}(?:eclipse public {L}|epl)(?: {V}2(?: 0)?)?
cddl-1                40 1.00 cddl,distribution               {U}(?:common development and distribution {L}|cddl)(?: {V}1 [01])?
cpl-1                 40 1.00 cpl,common                      {U}(?:common public {L}|cpl)(?: {V}1 0)?
isc                   40 1.00 isc                             {U}isc(?: {L})?
zlib                  40 1.00 zlib                            {U}zlib(?: libpng)?(?: {L})?
unlicense             40 1.00 unlicense                       {U}unlicense
wtfpl                 40 1.00 wtfpl                           {U}wtfpl
artistic-2            41 1.00 artistic                        {U}artistic {L} {V}2(?: 0)?
artistic-1            40 0.90 artistic                        {U}artistic {L}(?: {V}1(?: 0)?)?
bsl-1                 40 1.00 boost                           {U}boost(?: software)? {L}
busl-1.1              40 1.00 business,busl                   {U}(?:business source {L}|busl)
python-2              40 1.00 python,psf                      {U}(?:python software foundation|psf) {L}
eupl-1.2              40 1.00 european,eupl                   {U}(?:european union public {L}|eupl)
ms-pl                 40 1.00 microsoft                       {U}microsoft public {L}
ms-rl                 40 1.00 microsoft                       {U}microsoft reciprocal {L}
ofl-1.1               40 1.00 sil,ofl                         {U}(?:sil open font {L}|ofl)
postgresql            40 1.00 postgresql                      {U}postgresql {L}
zpl-2.1               40 1.00 zope                            {U}zope public {L}
afl-3                 40 1.00 academic                        {U}academic free {L}
osl-3                 40 1.00 open+software                   {U}open software {L}
sspl-1                40 1.00 side,sspl                       {U}(?:server side public {L}|sspl)
elastic-2             40 1.00 elastic                         {U}elastic {L}
vim                   40 1.00 vim                             {U}vim {L}
ruby                  40 1.00 ruby                            {U}ruby(?: s)? {L}
php-3                 40 1.00 php                             {U}php {L}
cc0-1                 41 1.00 cc0,zero                        {U}(?:creative commons )?(?:cc0|zero)
cc-by-nc-nd           43 1.00 nd,noderivs,noderivatives,derivatives,derivs  {U}(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:s|atives))
cc-by-nc-sa           43 1.00 sa,sharealike,alike             {U}(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)
cc-by-nc              42 1.00 nc,noncommercial,commercial     {U}(?:cc by nc|creative commons attribution non ?commercial)
cc-by-nd              42 1.00 nd,noderivs,noderivatives,derivatives,derivs  {U}(?:cc by nd|creative commons attribution no ?deriv(?:s|atives))
cc-by-sa              42 1.00 sa,sharealike,alike             {U}(?:cc by sa|creative commons attribution share ?alike)
cc-by                 41 1.00 by,attribution                  {U}(?:cc by|creative commons attribution)
odbl-1                40 1.00 odbl,database                   {U}(?:open database {L}|odbl)
gfdl                  40 1.00 gfdl,documentation              {U}(?:gnu free documentation {L}|gfdl)
ogl                   40 1.00 government                      {U}open government {L}
# names by themselves
mit                   30 0.85 mit,expat                       (?:mit|expat) {L}
mit                   20 0.70 mit                             {L} mit
apache-1.1            31 0.90 apache                          apache (?:software )?{L} {V}1 1
apache-2              31 0.90 apache,asl,apachev2             (?:apache (?:software )?{L} {V}2(?: 0)?|apache 2 0|asl 2 0)
apache-2              30 0.70 apache                          apache(?: software)? {L}
bsd-2-clause          31 0.90 bsd,freebsd                     (?:(?:bsd 2 clause|2 clause bsd|simplified bsd) {L}|freebsd {L}|bsd 2 clause)
bsd-3-clause          31 0.90 bsd                             (?:bsd 3 clause|3 clause bsd|new bsd {L}|modified bsd {L}|revised bsd {L})
bsd-4-clause          31 0.90 bsd                             (?:bsd 4 clause|4 clause bsd|original bsd {L})
bsd                   30 0.75 bsd                             (?:bsd(?: style| like)? {L}|{L} bsd)
gpl-2                 31 0.90 gpl,gplv2,gnu                   (?:gnu general public {L} {V}2(?: 0)?|gpl {V}2(?: 0)?|gplv2)
gpl-2-or-later        32 0.95 gpl,gplv2                       (?:gpl {V}2(?: 0)?|gplv2) or (?:later|newer|any later version)
gpl-3                 31 0.90 gpl,gplv3,gnu                   (?:gnu general public {L} {V}3(?: 0)?|gpl {V}3(?: 0)?|gplv3)
gpl-3-or-later        32 0.95 gpl,gplv3                       (?:gpl {V}3(?: 0)?|gplv3) or (?:later|newer|any later version)
gpl                   30 0.80 gpl,gnu                         (?:gnu general public {L}|gnu gpl|gpl {L}|{L} gpl)
gpl-exception         33 0.90 classpath                       classpath exception
gpl-exception         33 0.90 gcc+exception                   gcc runtime library exception
gpl-exception         33 0.90 bison+exception                 as a special exception {N}bison
gpl-exception         33 0.90 linking+exception               linking exception
gpl-exception         33 0.90 syscall+note                    linux syscall note
llvm-exception        33 0.90 llvm+exception,llvm+exceptions  (?:with )?llvm exceptions?
lgpl-2.1              31 0.90 lgpl,lgplv2,lesser              (?:gnu lesser general public {L} {V}2 1|lgpl {V}2 1|lgplv2 1)
lgpl-3                31 0.90 lgpl,lgplv3,lesser              (?:gnu lesser general public {L} {V}3(?: 0)?|lgpl {V}3(?: 0)?|lgplv3)
lgpl                  30 0.80 lgpl,lesser,library             (?:gnu (?:lesser|library) general public {L}|gnu lgpl|lgpl {L}|{L} lgpl)
agpl-3                31 0.90 agpl,agplv3,affero              (?:gnu affero general public {L} {V}3(?: 0)?|agpl {V}3(?: 0)?|agplv3)
agpl                  30 0.80 agpl,affero                     (?:gnu affero general public {L}|gnu agpl|agpl {L}|{L} agpl)
mpl-1                 31 0.90 mpl,mozilla                     (?:mozilla public {L}|mpl) {V}1 0
mpl-1.1               31 0.90 mpl,mozilla                     (?:mozilla public {L}|mpl) {V}1 1
mpl-2                 31 0.90 mpl,mozilla                     (?:mozilla public {L}|mpl) {V}2(?: 0)?
mpl                   30 0.80 mpl,mozilla                     (?:mozilla public {L}|mpl {L}|{L} mpl)
epl-1                 31 0.90 epl,eclipse                     (?:eclipse public {L}|epl) {V}1(?: 0)?
epl-2                 31 0.90 epl,eclipse                     (?:eclipse public {L}|epl) {V}2(?: 0)?
epl                   30 0.80 epl,eclipse                     (?:eclipse public {L}|epl {L})
edl-1                 30 0.85 edl,eclipse                     eclipse distribution {L}
cddl-1                30 0.85 cddl,distribution               (?:common development and distribution {L}|cddl {L}|cddl 1 [01])
cpl-1                 30 0.80 common+public,cpl               (?:common public {L}|cpl 1 0)
ipl-1                 30 0.85 ibm                             ibm public {L}
isc                   30 0.85 isc                             isc {L}
zlib                  30 0.85 zlib                            zlib(?: libpng)? {L}
unlicense             30 0.85 unlicense                       the unlicense
wtfpl                 30 0.90 wtfpl,fuck                      (?:do what the fuck you want to public {L}|wtfpl)
artistic-1            31 0.85 artistic                        artistic {L} {V}1(?: 0)?
artistic-2            31 0.90 artistic                        artistic {L} {V}2(?: 0)?
artistic              30 0.75 artistic                        (?:perl )?artistic {L}
bsl-1                 30 0.90 boost                           boost software {L}
busl-1.1              30 0.90 business,busl                   (?:business source {L}|busl 1 1)
python-2              30 0.90 python,psf                      (?:python software foundation {L}|psf {L})
eupl-1.1              31 0.90 eupl,european                   (?:european union public {L}|eupl) {V}1 1
eupl-1.2              30 0.85 eupl,european                   (?:european union public {L}|eupl)(?: {V}1 2)?
ms-pl                 30 0.85 microsoft,ms                    (?:microsoft public {L}|ms pl)
ms-rl                 30 0.85 microsoft,ms                    (?:microsoft reciprocal {L}|ms rl)
ms-eula               30 0.80 microsoft                       microsoft software {L} terms
ofl-1.1               30 0.90 sil,ofl                         (?:sil open font {L}|ofl 1 1)
postgresql            30 0.90 postgresql                      postgresql {L}
ncsa                  30 0.90 ncsa                            (?:university of illinois )?ncsa(?: open source)? {L}
openssl               30 0.90 openssl                         openssl {L}
php-3                 30 0.90 php                             php {L}
ruby                  30 0.85 ruby                            ruby(?: s)? {L}
zpl-2.1               30 0.90 zope,zpl                        (?:zope public {L}|zpl 2 1)
afl-3                 30 0.90 academic,afl                    (?:academic free {L}|afl 3 0)
osl-3                 30 0.80 osl,open+software               (?:open software {L}|osl 3 0)
sspl-1                30 0.90 side,sspl                       (?:server side public {L}|sspl)
elastic-2             30 0.90 elastic                         elastic {L}(?: {V}2 0)?
vim                   30 0.90 vim                             vim {L}
x11                   30 0.85 x11                             x11 {L}
ncbi                  30 0.85 ncbi,biotechnology              (?:ncbi public domain notice|national center for biotechnology information {N}public domain)
upl-1                 30 0.90 universal+permissive            universal permissive {L}
blueoak-1             30 0.90 blue+oak                        blue oak model {L}
hippocratic           30 0.90 hippocratic                     hippocratic {L}
watcom                30 0.90 watcom,sybase                   sybase open watcom public {L}
apsl-2                30 0.90 apple                           apple public source {L}
nasa                  30 0.90 nasa                            nasa open source agreement
qpl-1                 30 0.85 qpl,q+public                    (?:q public {L}|qpl 1 0)
sleepycat             30 0.90 sleepycat                       sleepycat {L}
tcl                   30 0.85 tcl                             tcl(?: tk)? {L}
w3c                   30 0.90 w3c                             w3c (?:software (?:notice and )?)?{L}
intel                 30 0.80 intel                           intel (?:simplified )?(?:software|open source) {L}
cecill-2.1            30 0.90 cecill                          cecill(?: b| c)?(?: free software)? {L}
mulan-2               30 0.90 mulan,mulanpsl                  (?:mulan permissive software {L}|mulanpsl)
rail                  30 0.90 rail,openrail                   (?:(?:bigscience |creativeml )?open ?rail(?: m| ml)?(?: {L})?)
llama                 30 0.90 llama                           llama (?:[2-4] )?(?:[0-9] )?community {L}
gemma                 30 0.85 gemma                           gemma terms of use
gfdl                  30 0.90 gfdl,documentation              (?:gnu free documentation {L}|gfdl(?: 1 [0-3])?)
odbl-1                30 0.90 odbl,database                   (?:open database {L}|odbl(?: 1 0)?)
odc-by                30 0.90 odc                             odc (?:by|attribution)
pddl                  30 0.90 pddl                            (?:public domain dedication and {L} pddl|pddl)
cdla                  30 0.90 cdla,community+data             (?:community data {L} agreement|cdla (?:permissive|sharing))
ogl                   30 0.90 government                      open government {L}
cc0-1                 31 0.90 cc0,zero                        (?:cc0(?: 1 0)?|creative commons zero)
cc-by-nc-nd           33 0.95 nc+nd,attribution               (?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)?|attribution noncommercial noderivatives)
cc-by-nc-sa           33 0.95 nc+sa,attribution               (?:cc by nc sa|creative commons attribution non ?commercial share ?alike|attribution noncommercial sharealike)
cc-by-nc              32 0.90 attribution                     (?:creative commons attribution non ?commercial|attribution noncommercial [1-4] 0)
cc-by-nd              32 0.90 nd,attribution                  (?:cc by nd|creative commons attribution no ?deriv(?:s|atives|ative works)?)
cc-by-sa              32 0.90 sa,attribution                  (?:cc by sa|creative commons attribution share ?alike|attribution sharealike [1-4] 0)
cc-by                 31 0.80 attribution,by                  (?:cc by [1-4] 0|creative commons attribution)
cc                    15 0.60 creative                        creative commons
# notices without a license's name
public-domain         25 0.80 domain                          (?:released|placed|dedicated|donated|belongs) (?:in|into|to) the public domain
public-domain         24 0.70 domain                          (?:this (?:work|file|software|code|book|image) is|are) in the public domain
us-government         25 0.80 work+government                 work of (?:the )?(?:united states|u s) government
non-commercial        22 0.80 commercial,noncommercial        (?:commercial use is (?:prohibited|not (?:permitted|allowed))|for non ?commercial (?:use|purposes) only|not for commercial use)
non-commercial        22 0.80 noncommercial                   (?:for )?noncommercial (?:use|purposes) only
research-only         22 0.80 research,academic               for (?:academic|research)(?: and (?:educational|research))? (?:use|purposes) only
personal-use          22 0.75 personal                        for (?:your )?personal (?:use|non ?commercial use) only
evaluation-only       22 0.75 evaluation                      for evaluation purposes only
no-derivatives        22 0.75 derivative                      (?:no derivative works|may not (?:create|make|prepare) derivative works)
no-ai-training        23 0.85 training,train                  (?:may not be used|not permitted|prohibited|not be used) (?:for|to) (?:the )?(?:purpose of )?train(?:ing)?
proprietary           22 0.80 proprietary                     (?:proprietary and confidential|confidential and proprietary)
proprietary           21 0.75 proprietary                     (?:is|are|contains?) proprietary (?:and trade secret )?(?:information|software|material|to)
proprietary           21 0.80 unauthorized,unauthorised       unauthori[sz]ed (?:copying|reproduction|distribution|use)(?: [a-z]+){0,6} (?:is|are) (?:strictly )?prohibited
proprietary           20 0.80 permission                      may not be (?:copied|reproduced|redistributed|republished)(?: or [a-z]+)? without(?: the)?(?: prior| express)?(?: written)? permission
proprietary           20 0.75 consent                         may not be (?:copied|reproduced|redistributed|republished)(?: or [a-z]+)? without(?: the)?(?: prior| express)?(?: written)? consent
proprietary           19 0.75 reproduced+part                 no part of this (?:publication|book|document|work) may be reproduced
proprietary           18 0.70 eula,agreement                  end user {L} agreement
proprietary           10 0.50 reserved                        all rights reserved
proprietary           10 0.50 rechte                          alle rechte vorbehalten
proprietary           10 0.50 droits                          tous droits r(?:e|é)serv(?:e|é)s
proprietary           10 0.50 derechos                        todos los derechos reservados
dual-license          17 0.60 dual,dually                     (?:dual|dually) licen[cs]ed
copyright              5 0.40 copyright                       copyright (?:c )?(?:19|20)[0-9][0-9]
"""


class Rule(NamedTuple):
    pattern: str
    label: str
    priority: int
    confidence: float
    keywords: tuple[frozenset[str], ...]  # all words of one of these must be among the text's


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """All signatures by falling priority, in the table's order within one."""
    made = []
    for line in TABLE.strip().splitlines():
        if line.startswith("#"):
            continue
        label, priority, confidence, keywords, pattern = line.split(maxsplit=4)
        pattern = re.sub(r"\{[LUVN]\}", lambda m: PARTS[m[0]], pattern)
        made.append(Rule(pattern, label, int(priority), float(confidence), tuple(frozenset(k.split("+")) for k in keywords.split(","))))
    made += [Rule(phrase, label, 35, 0.9, (frozenset(phrase.split()),)) for phrase, label in BASE.items()]
    return tuple(sorted(made, key=lambda r: -r.priority))
