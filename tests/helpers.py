"""Short ways to make venue tables in tests."""

from rankweave.schema import VENUE


def venue(pos, ident, name, kind="journal", **more):
    row = dict.fromkeys(VENUE.names) | {"id": ident, "type": kind, "canonical_name": name, "aliases": [], "pos": pos} | more
    return tuple(row[n] for n in VENUE.names)


def venues(spark, *rows):
    return spark.createDataFrame(list(rows), VENUE)


def rank(value, catalog="X", edition=None):
    return {"rank": value, "edition": edition, "source_url": None, "catalog": catalog}


def school(catalog, value, edition=None):
    return {"catalog": catalog, "rank": value, "edition": edition, "source_url": None}


def label(kind, text, edition=None):
    return {"kind": kind, "text": text, "edition": edition}
