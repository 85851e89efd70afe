"""Canonical page address: two links that lead to the same page, however written, come out equal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that say how a reader came to a page, not which page it is.
TRACKING = r"(?i)^(?:utm_[a-z_]*|fbclid|gclid|dclid|msclkid|igshid|mc_[ce]id|yclid|_ga|_hs[a-z]*|ref|ref_src|referrer|source|src|spm|cmpid|campaign|share|amp|sessionid|sid|phpsessid|jsessionid)(?:=|$)"


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, www./m./amp., default port, fragment, tracking parameters and closing slashes.

    The host's case doesn't matter, the path's and the parameters' do; parameters are put in order.  Null and
    blank links, and links without a host, give null.
    """
    bare = F.regexp_replace(F.trim(url), r"^(?i:[a-z][a-z0-9+.\-]*:)?//", "")
    bare = F.regexp_replace(bare, r"#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^(?:www\d?|m|mobile|amp)\.|:(?:80|443)$|\.$", "")
    host = F.regexp_replace(host, r"^(?:www\d?|m|mobile|amp)\.|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/{2,}", "/"), r"(?:/amp)?/*$|/index\.html?$", "")
    query = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "[&;]")
    kept = F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(TRACKING) & ~p.rlike("=$")))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))
