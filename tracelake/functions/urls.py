"""Source locations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import let

# Query parameters that only track the visitor.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "ref", "ref_src", "fbclid", "gclid", "mc_eid", "igshid",
)
_URL = r"(?i)^([a-z][a-z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:]*)(?::(\d+))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


_MARK = "\u0001"


def normalize_location(location: Column, kind: Column | None = None) -> Column:
    """One spelling per location: host lower, default port, fragment and tracking dropped, query sorted."""
    raw = F.regexp_replace(location, r"^\s+|\s+$", "")
    wanted = F.coalesce(kind == "URL", F.lit(False)) if kind is not None else F.lit(False)

    def build(v: Column) -> Column:
        return let(F.split(F.regexp_replace(v, _URL, _MARK.join(f"${i}" for i in range(1, 7))), _MARK), lambda p: chosen(v, p))

    def chosen(v: Column, p: Column) -> Column:
        is_url = wanted | v.rlike(r"(?i)^[a-z][a-z0-9+.-]*://")
        good = (F.size(p) == 6) & ((F.get(p, 2) != "") | (F.lower(F.get(p, 0)) == "file"))
        return (
            F.when(v == "", F.lit(None).cast("string")).when(is_url & good, assembled(p)).when(is_url, v)
            .otherwise(F.regexp_replace(v, "/+", "/"))
        )

    def assembled(p: Column) -> Column:
        scheme, port = F.lower(F.get(p, 0)), F.get(p, 3)
        default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
        shown = F.when((port == "") | default, "").otherwise(F.concat(F.lit(":"), port))
        user = F.when(F.get(p, 1) == "", "").otherwise(F.concat(F.get(p, 1), F.lit("@")))
        path = let(F.regexp_replace(F.get(p, 4), "/+", "/"), lambda x: F.when(x == "", "/").when(
            (F.length(x) > 1) & F.endswith(x, F.lit("/")), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x))
        pairs = F.transform(
            F.filter(F.split(F.get(p, 5), "&"), lambda q: q != ""),
            lambda q, i: F.struct(
                F.substring_index(q, "=", 1).alias("k"), i.alias("i"),
                F.when(F.contains(q, F.lit("=")), q).otherwise(F.concat(q, F.lit("="))).alias("p"),
            ),
        )
        kept = F.filter(pairs, lambda q: ~F.lower(q["k"]).isin(*TRACKING_PARAMS))
        query = let(F.array_join(F.transform(F.array_sort(kept), lambda q: q["p"]), "&"), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
        return F.concat(scheme, F.lit("://"), user, F.lower(F.get(p, 2)), shown, path, query)

    return F.when(location.isNotNull(), let(raw, build))


def archive_embedded_location(normalized: Column) -> Column:
    """The original location inside a web archive address; null for other addresses."""
    inner = F.regexp_extract(
        normalized, r"(?i)^https?://(?:web\.)?archive\.org(?::\d+)?/web/[0-9*]+(?:[a-z_]+)?/([^?#]+)", 1
    )
    # Slash runs in the path were squeezed, so the scheme of the inner address has one slash left.
    inner = F.regexp_replace(F.try_url_decode(inner), "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1://")
    return F.when(inner != "", normalize_location(inner))
