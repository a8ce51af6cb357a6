"""Citation strings to fields, as Column functions without UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, _col, let, some, squeeze

YEAR = "(?:19|20)\\d{2}"
ELLIPSIS_EDGE = "^(?:…|\\.\\.\\.)|(?:…|\\.\\.\\.)$"
ELLIPSIS = "…|\\.\\.\\."


def _extract(x: Column, pattern: str, group: int = 1) -> Column:
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, group))


def scholar_metadata(c: Column | str) -> Column:
    """``authors - publication - publisher`` to a struct of fields."""
    dated = f"^(.*),[{WS}]*({YEAR})$"

    def of_parts(text: Column, parts: Column) -> Column:
        n, second = F.size(parts), some(F.get(parts, F.lit(1)))
        middle = some(squeeze(F.array_join(F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0))), " - ")))
        publication = F.when(n >= 3, middle).when((n == 2) & second.rlike(dated), second)
        publisher = F.when(n >= 3, some(F.element_at(parts, -1))).when((n == 2) & ~F.coalesce(second.rlike(dated), F.lit(False)), second)
        return let(F.struct(publication.alias("publication"), publisher.alias("publisher")), lambda p: of_publication(text, parts, p["publication"], p["publisher"]))

    def of_publication(text: Column, parts: Column, publication: Column, publisher: Column) -> Column:
        only, both = publication.rlike(f"^{YEAR}$"), publication.rlike(dated)
        venue = F.when(only, F.lit(None)).when(both, some(squeeze(F.regexp_extract(publication, dated, 1)))).otherwise(publication)
        year = F.when(only, publication).when(both, F.regexp_extract(publication, dated, 2)).cast("int")
        return let(venue, lambda v: F.struct(
            text.alias("metadata_text"), some(F.get(parts, F.lit(0))).alias("authors_text"), publication.alias("publication_text"),
            v.alias("venue_candidate"), publisher.alias("publisher_text"), year.alias("year"),
            F.coalesce(v.rlike(ELLIPSIS_EDGE), F.lit(False)).alias("source_truncated"),
        ))

    split = lambda text: F.transform(F.split(text, f"[{WS}]+[-–—][{WS}]+", -1), squeeze)
    return let(squeeze(c), lambda text: let(split(text), lambda parts: of_parts(text, parts)))


def pubmed_journal(c: Column | str) -> Column:
    """The abbreviated journal before the date; null for books and undated text."""
    text = squeeze(c)
    got = _extract(text, f"^(.{{1,200}}?)\\.[{WS}]+{YEAR}(?=[{WS}]|[.;:]|$)")
    return F.when(~text.rlike(f"(?i)^In[{WS}]*:"), some(squeeze(got)))


def first_year(c: Column | str) -> Column:
    return _extract(_col(c), f"({YEAR})").cast("int")


def source_text(c: Column | str) -> Column:
    """Without a leading field label."""
    return some(squeeze(F.regexp_replace(_col(c), f"^(?:来源|刊名|会议名称)[{WS}]*[:：][{WS}]*", "")))


# Complete proceedings titles that are known, lower-cased, and the venue of each.
PMLR_VENUES = {
    "international conference on machine learning": "International Conference on Machine Learning",
    "international conference on artificial intelligence and statistics": "International Conference on Artificial Intelligence and Statistics",
    "conference on learning theory": "Annual Conference on Computational Learning Theory",
    "conference on uncertainty in artificial intelligence": "Conference on Uncertainty in Artificial Intelligence",
    "uncertainty in artificial intelligence": "Conference on Uncertainty in Artificial Intelligence",
    "international conference on algorithmic learning theory": "International Conference on Algorithmic Learning Theory",
    "algorithmic learning theory": "International Conference on Algorithmic Learning Theory",
}
# Venue names of proceedings sites.
CVF_VENUES = {
    "CVPR": "IEEE/CVF Computer Vision and Pattern Recognition Conference",
    "ICCV": "International Conference on Computer Vision",
    "WACV": "IEEE/CVF Winter Conference on Applications of Computer Vision",
    "ACCV": "Asian Conference on Computer Vision",
}
USENIX_VENUES = {
    "osdi": "USENIX Symposium on Operating Systems Design and Implementation",
    "fast": "USENIX Conference on File and Storage Technologies",
    "usenixsecurity": "USENIX Security Symposium",
    "atc": "USENIX Annual Technical Conference",
    "nsdi": "USENIX Symposium on Networked Systems Design and Implementation",
}
NEURIPS_VENUE = "Conference on Neural Information Processing Systems"
ACL_VENUE = "Annual Meeting of the Association for Computational Linguistics"


def pmlr_venue(c: Column | str) -> Column:
    source = _col(c)
    title = F.regexp_replace(F.regexp_replace(source, "(?i)^Proceedings of (?:the )?", ""), "(?i)^\\d+(?:st|nd|rd|th) ", "")
    known = F.create_map(*[F.lit(x) for kv in PMLR_VENUES.items() for x in kv])
    return F.coalesce(known[F.lower(title)], source)


def acl_venue(path: Column | str, venue: Column | str) -> Column:
    """The main conference, if path and volume title agree on the track; else the source."""
    at, source = _col(path), _col(venue)
    volume = "^Proceedings of the \\d+(?:st|nd|rd|th) Annual Meeting of the Association for Computational Linguistics \\(Volume {}: {} Papers\\)$"
    long = at.rlike("^/\\d{4}\\.acl-long\\.\\d+/$") & source.rlike(volume.format(1, "Long"))
    short = at.rlike("^/\\d{4}\\.acl-short\\.\\d+/$") & source.rlike(volume.format(2, "Short"))
    return F.when((long | short) & ~source.rlike(ELLIPSIS), F.lit(ACL_VENUE)).otherwise(source)
