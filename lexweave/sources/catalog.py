"""The catalogue of known licences: 19 rows, whose order breaks ties."""

from __future__ import annotations

import re
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.tidy import SPACE

#: Texts by file name; another folder can be given everywhere.
TEXTS = Path(__file__).resolve().parent / "license_texts"

#: Name, address and id of each licence, in their order.
LICENSES = (
    ("Unlicense", "https://unlicense.org/", "Unlicense"),
    ("MIT License", "https://opensource.org/licenses/MIT", "MIT"),
    ("BSD 2-Clause License", "https://opensource.org/licenses/BSD-2-Clause", "BSD-2-Clause"),
    ("BSD 3-Clause License", "https://opensource.org/licenses/BSD-3-Clause", "BSD-3-Clause"),
    ("Apache License 2.0", "https://opensource.org/licenses/Apache-2.0", "Apache-2.0"),
    ("Header of Apache License 2.0", "https://opensource.org/licenses/Apache-2.0", "Apache-2.0_SHORT"),
    ("GNU General Public License version 2 (GPL-2.0)", "https://opensource.org/licenses/GPL-2.0", "GPL-2.0"),
    ("Header of GNU General Public License version 2 (GPL-2.0)", "https://opensource.org/licenses/GPL-2.0", "GPL-2.0_SHORT"),
    ("GNU General Public License version 3 (GPL-3.0)", "https://opensource.org/licenses/GPL-3.0", "GPL-3.0"),
    ("Header of GNU General Public License version 3 (GPL-3.0)", "https://opensource.org/licenses/GPL-3.0", "GPL-3.0_SHORT"),
    ("Mozilla Public License 1.0 (MPL-1.0)", "https://opensource.org/licenses/MPL-1.1", "MPL-1.0"),
    ("Mozilla Public License 1.1 (MPL-1.1)", "https://opensource.org/licenses/MPL-1.1", "MPL-1.1"),
    ("Mozilla Public License 2.0 (MPL-2.0)", "https://opensource.org/licenses/MPL-2.0", "MPL-2.0"),
    ("The zlib/libpng License (Zlib)", "https://opensource.org/licenses/Zlib", "Zlib"),
    ("Eclipse Public License 1.0 (EPL-1.0)", "https://opensource.org/licenses/EPL-1.0", "EPL-1.0"),
    ("Eclipse Public License 2.0 (EPL-2.0)", "https://opensource.org/licenses/EPL-2.0", "EPL-2.0"),
    ("GNU Affero General Public License v3 (AGPL-3.0)", "https://opensource.org/licenses/AGPL-3.0", "AGPL-3.0"),
    ("GNU Lesser General Public License version 2.1 (LGPL-2.1)", "https://opensource.org/licenses/LGPL-2.1", "LGPL-2.1"),
    ("GNU Lesser General Public License version 3 (LGPL-3.0)", "https://opensource.org/licenses/LGPL-3.0", "LGPL-3.0"),
)


def normalize(text: str) -> str:
    """White space runs to one space; a line break after each full stop. The Column form is functions.text.normalize."""
    return re.sub(SPACE + "+", " ", text).replace(".", ".\n")


_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")


def through_page(text: str) -> str:
    """The text as it comes back from a page that it was put into without escapes.

    What looks like a tag becomes an element: names in lower case, further words as empty attributes, and all
    elements that are open at the end closed there, innermost first. The first line break is dropped.
    """
    open_names: list[str] = []

    def element(match: re.Match) -> str:
        closing, name, rest = match[1], match[2].lower(), match[3]
        if closing:
            if name not in open_names:
                return ""
            out = ""
            while open_names:
                out += f"</{(last := open_names.pop())}>"
                if last == name:
                    break
            return out
        open_names.append(name)
        words = dict.fromkeys(w.lower() for w in re.split(r"[\s/]+", rest) if w)
        return "<" + name + "".join(f" {w}" + ('=""' if "=" not in w else "") for w in words) + ">"

    out = _TAG.sub(element, text.removeprefix("\n"))
    return out + "".join(f"</{name}>" for name in reversed(open_names))


@lru_cache(maxsize=4)
def rows(folder: str | None = None) -> tuple[tuple[int, str, str, str, str], ...]:
    """(ord, name, url, license_id, text), read on the driver."""
    place = Path(folder) if folder else TEXTS
    return tuple((k, name, url, key, (place / key).read_text("utf-8")) for k, (name, url, key) in enumerate(LICENSES))


def catalog(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """ord, name, url, license_id, text, norm_text, norm_text_dom."""
    from ..functions.text import normalize as normalize_column

    table = [(*r, through_page(r[4])) for r in rows(folder)]
    df = spark.createDataFrame(table, "ord int, name string, url string, license_id string, text string, dom string")
    return df.withColumn("norm_text", normalize_column(F.col("text"))).withColumn("norm_text_dom", normalize_column(F.col("dom"))).drop("dom")


def scan_texts(spark: SparkSession, folder: str) -> DataFrame:
    """license_id (the file's name) and text of every file in a folder; any folder that Spark can read."""
    files = spark.read.text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("license_id"), F.col("value").alias("text"))
