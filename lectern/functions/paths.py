"""File names as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_path(path: Column) -> Column:
    """The one way to write a file's path.

    A file: URI loses its scheme and host and is percent-decoded (as it stands
    if the escapes are broken); a plain path is never decoded. Empty and '.'
    parts vanish, '..' takes the part before it away. Letter case stays. Null
    gives null.
    """
    is_uri = path.rlike(r"^(?i:file):")
    bare = F.regexp_replace(path, r"^(?i:file):(//(?i:localhost)?(?=/))?", "")
    decoded = F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
    plain = F.when(is_uri, decoded).otherwise(path)
    parts = F.filter(F.split(plain, "/"), lambda x: ~x.isin("", "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.concat(acc, F.array(x))
        ),
    )
    return F.concat(F.when(plain.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))
