import duckdb
import pytest
from test_licenses import TEXT, brute, cases

from ritardo.llm import licenses

PUBLISHED = {
    "gpl-3-later": """Copyright (C) 2020 A. Author

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
""",
    "gpl-2-later": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.
""",
    "mpl-2-header": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
""",
    "apache-header-lines": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
""",
}


@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// "])
def test_published_notices_are_found(docs_of, prefix):
    """As wrapped by their licensors, plain and as comments, whose blank lines hold the sign alone."""
    texts = [*PUBLISHED.values(), *TEXT.values()]
    rows = [(i, "int x;\n" + "\n".join((prefix + line).rstrip() for line in t.splitlines()) + "\ny();")
            for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in licenses.scan(docs_of(rows)).collect()}
    for (i, t), rule in zip(rows, [*PUBLISHED, *TEXT], strict=False):
        assert rule in got[i].rules, (prefix, rule)
    for i, t in rows:
        assert (",".join(got[i].rules), got[i].n_sentences) == brute(t), i


def test_against_sql(docs_of):
    rows = list(enumerate([*PUBLISHED.values(), *cases(), *[
        t.replace("\n", "\n# ") for t in PUBLISHED.values()]]))
    got = licenses.scan(docs_of(rows)).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted((r.doc_id, ",".join(r.licenses), ",".join(r.rules), r.n_sentences)
                  for r in got) == sorted(con.execute(licenses.oracle_sql()).fetchall())
