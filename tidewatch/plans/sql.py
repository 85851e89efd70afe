"""The core queries in SQL, for comparison."""

from __future__ import annotations

from tidewatch.sources import querygen

#: Fixed values, written out once more so that the comparison doesn't repeat the library's lists.
_TRACK = "'utm_source','utm_medium','utm_campaign','utm_term','utm_content','fbclid','gclid','mc_cid','mc_eid','ref','ref_src','igshid','_ga','yclid','msclkid','spm'"
_LAB = "university|université|universidad|universität|universiteit|universita|institute|institut|instituto|academy|académie|akademie|academia|college|school of|école|escola|laboratory|laboratoire|laboratorio|national center|national centre|centre national|centro nacional|research center|research centre|centre de recherche|polytechnic|politecnico|polytechnique|fraunhofer|helmholtz|max planck|leibniz|cnrs|inserm|inria|synchrotron|observatory|observatoire|hochschule| epfl | ethz | mit | caltech | kaist "
_FIRM = " gmbh| ag | inc| ltd| corp| llc| s\\.a| b\\.v\\.| bv| co\\.| k\\.k\\.| pty| s\\.r\\.l\\.| s\\.p\\.a\\.| sa | plc| ab | oy| technologies| systems| industries| manufacturing| coatings| materials"
_KIND = f"case when regexp_matches(n, '{_LAB}') then 'research_org' when regexp_matches(n, '{_FIRM}') then 'company' when list_contains(src, 'openalex') and not list_contains(src, 'patents') then 'research_org' else 'company' end"


def _url(c: str) -> str:
    u = f"regexp_replace(trim(coalesce({c},'')), '#.*$', '')"
    base = f"regexp_extract({u}, '^([^?]*)', 1)"
    host = f"regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/]*)', 1)"
    path = f"regexp_replace(substr({base}, length({host}) + 1), '/+$', '')"
    q = f"array_to_string(list_filter(string_split(regexp_extract({u}, '\\?(.*)$', 1), '&'), lambda p: contains(p, '=') and not ends_with(p, '=') and not lower(split_part(p, '=', 1)) in ({_TRACK})), '&')"
    return f"lower({host} || case when {path} = '' and {host} <> '' then '/' else {path} end || case when {q} <> '' then '?' || {q} else '' end)"


_STRIPPED = "regexp_replace(trim(coalesce(title,'')), '\\s+[-–—]\\s+[^-–—]{1,60}$', '')"
_TITLE = f"trim(regexp_replace(regexp_replace(lower({_STRIPPED}), '[^\\pL\\pN_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_ID = "substr(md5(case when trim(coalesce(link,'')) <> '' then trim(coalesce(link,'')) else substr(coalesce(title,'') || coalesce(summary,''), 1, 500) end), 1, 12)"
_TOK = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"
_CJK = "case when length(coalesce(text,'')) = 0 then 0.0 else length(regexp_replace(text, '[^\\x{3000}-\\x{9fff}\\x{ff00}-\\x{ffef}]', '', 'g')) / length(text) end"
_LATEST = "select article_id, lower(rating) as rating, date from (select *, row_number() over (partition by article_id order by date desc nulls last, feedback_id desc) n from feedback where article_id is not null and lower(rating) in ('up','down')) where n = 1"
_FIRMS = "select term, n from (select regexp_extract(coalesce(query,''), '^\"([^\"]+)\"', 1) as term, count(*) n from query_stats group by 1) where term <> '' "
_CAT = "lower(trim(coalesce(category,'')))"
_NQ = "regexp_replace(trim(regexp_replace(regexp_replace(lower(trim(coalesce({},''))), '^\"+|\"+$', '', 'g'), '^''+|''+$', '', 'g')), '\\s+', ' ', 'g')"
_NA = "regexp_replace(lower(trim(coalesce(name,''))), '\\s+', ' ', 'g')"
_RUNS = """
 e as (select cast(user_id as varchar) as query, event_type as source, cast(ts as date) as run from events),
 c as (select query, source, run, count(*) n from e group by all),
 k as (select distinct query, source from e), r as (select distinct run from e),
 runs as (select k.query, k.source, r.run, coalesce(c.n, 0) as hits from k cross join r left join c on c.query = k.query and c.source = k.source and c.run = r.run)"""
_BM25 = """
 docs as (select pos, {tok} as t from article),
 n as (select count(*) n, avg(len(t)) avgdl from docs),
 f as (select term, count(*) df from (select unnest(list_distinct(t)) term from docs) group by 1),
 m as (select avg(ln((n - df + 0.5) / (df + 0.5))) mean_idf from f, n),
 q as (select * from (values ('coatings', 2), ('hardness', 1), ('films', 1), ('gain', 1), ('vacuum', 1)) v(term, qtf)),
 w as (select f.term, qtf, avgdl, case when ln((n - df + 0.5) / (df + 0.5)) < 0 then 0.25 * mean_idf else ln((n - df + 0.5) / (df + 0.5)) end idf from f join q using (term), n, m),
 tf as (select pos, len(t) dl, term, count(*) tf from (select pos, t, unnest(t) term from docs) where term in (select term from q) group by 1, 2, 3),
 scored as (select pos, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from tf join w using (term) group by 1)""".replace("{tok}", "regexp_extract_all(lower(trim(coalesce(title,'') || '. ' || coalesce(summary,''))), '[a-z0-9]+')")
_STERILE = f"""
 with t as (select 'solo_keywords' as list_name, stat_id as pos, regexp_replace(query, '^\"|\"$', '', 'g') as term from query_stats where query is not null),
 s as (select {_NQ.format('query')} as k, max(hits_total) most, max(case when runs_total >= 8 and consecutive_zeros >= 8 then 1 else 0 end) tried from query_stats group by 1)
 select pos as stat_id, term from t join s on s.k = {_NQ.format('term')} where s.k <> '' and most <= 0 and tried = 1"""


def _vectors(where: str, col: str, pattern: str, limit: int, min_df: int, max_df: float) -> str:
    return f"""
 docs as (select pos, regexp_extract_all(lower(coalesce({col},'')), '{pattern}') as t from article where {where}),
 n as (select count(*) n from docs),
 tf as (select pos, term, count(*) tf from (select pos, unnest(t) term from docs) group by 1, 2),
 f as (select term, count(*) df, sum(tf) cf, any_value(n.n) n from tf, n group by term having count(*) >= {min_df} and count(*) <= {max_df} * any_value(n.n) order by cf desc, term limit {limit}),
 x as (select pos, term, df, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) w from tf join f using (term)),
 nn as (select pos, sqrt(sum(w * w)) norm from x group by 1),
 v as (select pos, term, df, w / norm as w from x join nn using (pos))"""


_PAIRS = "with " + _vectors("length(title) > 20", "title", r"[\pL\pN_]{2,}", 8000, 1, 1.0) + ", pairs as (select a.pos as a, b.pos as b, sum(a.w * b.w) as cosine from v a join v b on a.term = b.term and a.pos < b.pos group by 1, 2 having sum(a.w * b.w) >= 0.85)"
_COMP = _PAIRS.replace("with ", "with recursive ", 1) + """,
 e as (select a as u, b as v from pairs union select b, a from pairs),
 reach as (select u as node, u as r from e union select e.u as node, reach.r from e join reach on e.v = reach.node),
 comp as (select node, min(r) as root from reach group by node)"""


def _querygen() -> str:
    """Each source's templates over the target lists, as one union."""
    parts = []
    for source, templates in querygen.TEMPLATES.items():
        parts += ["select '%s' as source, '%s' as query" % (source, q.replace("'", "''")) for q in querygen.BASE[source]]
        for name, t in zip(querygen.LISTS, templates):
            if t:
                say = "'" + t.replace("%1$s", "%s").replace("%s", "' || term || '") + "'"
                parts.append(f"select '{source}', {say} from target_terms where list_name = '{name}' and length(trim(term)) > 0")
    return " union ".join(parts)


def oracle_sql() -> dict[str, str]:
    days = "['lundi','mardi','mercredi','jeudi','vendredi','samedi','dimanche']"
    months = "['janvier','février','mars','avril','mai','juin','juillet','août','septembre','octobre','novembre','décembre']"
    hay = "lower(coalesce(title,'') || ' ' || coalesce(summary,'') || ' ' || coalesce(source,''))"
    blob = "lower(coalesce(title,'') || ' ' || coalesce(summary,'') || ' ' || coalesce(source,'') || ' ' || coalesce(patent_assignee,''))"
    tgt = "(select * from target_terms where length(trim(term)) > 0)"
    return {
        "q_url_normalize": f"select pos, {_url('link')} as url, coalesce(lower(string_split(link, '/')[3]), 'unknown') as domain from article where link is not null",
        "q_url_dedup": f"select min(pos) as pos from article where length(trim(link)) > 0 group by {_url('link')}",
        "q_title_normalize": f"select pos, {_TITLE} as title from article",
        "q_title_dedup": f"with t as (select pos, {_TITLE} as k, length(coalesce(summary,'')) l from article), r as (select pos, k, row_number() over (partition by k order by l desc, pos) n, min(pos) over (partition by k) slot from t where k <> '') select pos, slot, false as untitled from r where n = 1 union all select pos, pos, true from t where k = ''",
        "q_article_id": f"select pos, {_ID} as article_id from article",
        "q_prompt_version": "select doc_id, substr(sha1(coalesce(text,'')), 1, 8) as version from documents",
        "q_token_stats": f"select doc_id, len({_TOK.format('text')}) as n_tokens, len(list_distinct({_TOK.format('text')})) as n_distinct from documents",
        "q_doc_freq": f"select term, count(*) as df from (select unnest(list_distinct({_TOK.format('text')})) as term from documents) group by term",
        "q_cjk": f"select doc_id, {_CJK} > 0.30 as mostly_cjk from documents",
        "q_strip_tags": "select doc_id, md5(trim(regexp_replace(regexp_replace(coalesce(text,''), '<[^>]+>', ' ', 'g'), '[ \\n]+', ' ', 'g'))) as plain from documents",
        "q_blocked": "select doc_id, regexp_matches(lower(substr(coalesce(text,''), 1, 4000)), 'captcha|are you a human|verify you are not a bot|rate limit exceeded|too many requests|unusual traffic from your computer|automated queries|access denied|blocked by|cloudflare ray id') as blocked from documents",
        "q_epodoc": r"select pos, case when regexp_matches(trim(patent_pub_num), '^([A-Z]{2})([\d/\-]+?)([A-Z]\d?)?$') then regexp_extract(trim(patent_pub_num), '^([A-Z]{2})([\d/\-]+?)([A-Z]\d?)?$', 1) || '.' || regexp_replace(regexp_extract(trim(patent_pub_num), '^([A-Z]{2})([\d/\-]+?)([A-Z]\d?)?$', 2), '[/\-]', '', 'g') || case when regexp_extract(trim(patent_pub_num), '^([A-Z]{2})([\d/\-]+?)([A-Z]\d?)?$', 3) <> '' then '.' || regexp_extract(trim(patent_pub_num), '^([A-Z]{2})([\d/\-]+?)([A-Z]\d?)?$', 3) else '' end end as epodoc from article where patent_pub_num is not null",
        "q_feedback_subject": "select feedback_id, case when lower(rating) in ('up','down') and regexp_matches(lower(article_id), '^[a-f0-9]{12}') then lower(rating) end as rating, case when lower(rating) in ('up','down') and regexp_matches(lower(article_id), '^[a-f0-9]{12}') then substr(lower(article_id), 1, 12) end as id from feedback where rating is not null and article_id is not null",
        "q_llm_parse": "select pos, pos as id, coalesce(score, 0) as score, round(case when confidence is null then 0.8 else greatest(0.0, least(1.0, confidence * 2)) end, 6) as confidence from article",
        "q_actor_classify": f"select actor_id, {_KIND} as kind from (select actor_id, ' ' || lower(coalesce(name,'')) || ' ' as n, coalesce(sources, []) as src from discovered_actors)",
        "q_presentation": f"select pos, case when length(coalesce(summary,'')) > 220 then substr(summary, 1, 220) || '…' else coalesce(summary,'') end as short, case when score between 1 and 5 then repeat('★', score) || repeat('☆', 5 - score) else '' end as stars, {days}[isodow(published_at)] || ' ' || day(published_at) || ' ' || {months}[month(published_at)] || ' ' || year(published_at) as jour, week(published_at) as week from article where published_at is not null",
        "q_prefilter": f"select pos from article where contains({hay}, 'thin film') or contains({hay}, 'solar modules') or contains({hay}, 'wear resistance') or list_has_any(regexp_extract_all({hay}, '[\\pL\\pN_]+'), ['tin','hardness','membranes']) or trim({hay}) = ''",
        "q_recency": "select pos from article where published_at is null or floor((epoch(timestamp '2025-08-01 00:00:00') - floor(epoch(published_at))) / 86400) <= 90",
        "q_required": "select pos from article where length(trim(title)) > 0 and length(trim(link)) > 0",
        "q_source_counts": "select split_part(coalesce(source,''), ' — ', 1) as family, count(*) as n from article group by 1",
        "q_seen_flag": f"select pos, {_url('link')} in (select {_url('link')} from article where batch_no = 0 and link is not null) as seen from article where batch_no >= 1",
        "q_seen_anti": f"select pos from article where batch_no >= 1 and {_url('link')} not in (select {_url('link')} from article where batch_no = 0 and link is not null)",
        "q_mentions": f"with f as ({_FIRMS}), m as (select f.term, count(*) total, count(*) filter ({_CAT} = 'patent') patents from article a join f on contains({blob}, lower(f.term)) where trim({blob}) <> '' group by 1) select f.term, coalesce(total, 0) as total, coalesce(patents, 0) as patents, coalesce(total, 0) - coalesce(patents, 0) as others from f left join m using (term)",
        "q_company_floor": f"with f as (select term, row_number() over (order by term) p from ({_FIRMS})), m as (select a.pos, arg_min(f.term, f.p) company from article a join f on contains(lower(coalesce(title,'') || ' ' || coalesce(summary,'')), lower(f.term)) group by 1) select a.pos, case when company is null then score else greatest(coalesce(score, 4), 4) end as score, company from article a left join m using (pos)",
        "q_archive_upsert": "with r as (select pos, score, collected_at, row_number() over (partition by regexp_replace(trim(coalesce(link,'')), '/+$', '') order by batch_no desc, pos desc) n from article where regexp_replace(trim(coalesce(link,'')), '/+$', '') <> '') select pos, score from r where n = 1 order by collected_at desc nulls last, pos limit 5000",
        "q_feedback_latest": _LATEST,
        "q_few_shot": f"with f as ({_LATEST}), a as (select {_ID} as article_id, arg_min(title, pos) as title from article where length(title) > 0 and length(summary) > 0 group by 1), r as (select rating, article_id, title, date, row_number() over (partition by rating order by date desc nulls last, article_id) n from f join a using (article_id)) select rating, article_id, title, date from r where n <= 3",
        "q_feedback_join": f"with f as ({_LATEST}) select a.pos, f.rating as user_feedback from (select pos, {_ID} as article_id from article) a left join f using (article_id)",
        "q_query_stats": f"with {_RUNS}, i as (select *, sum(case when hits > 0 then 1 else 0 end) over (partition by query, source order by run) isl from runs) select query, source, run, cast(sum(hits) over w as bigint) as hits_total, count(*) over w as runs_total, cast(sum(case when hits = 0 then 1 else 0 end) over (partition by query, source, isl order by run) as bigint) as consecutive_zeros, max(case when hits > 0 then run end) over w as last_hit_run from i window w as (partition by query, source order by run)",
        "q_stats_merge": "with st as (select query, source, max(hits_total) ht, max(runs_total) rt, max(consecutive_zeros) cz, max(last_hit_run) lh from query_stats group by 1, 2), r as (select query, source, length(query) % 3 as hits from st where ht is not null) select coalesce(st.query, r.query) as query, coalesce(st.source, r.source) as source, coalesce(ht, 0) + coalesce(hits, 0) as hits_total, coalesce(rt, 0) + case when hits is null then 0 else 1 end as runs_total, case when coalesce(hits, 0) > 0 then 0 else coalesce(cz, 0) + case when hits is null then 0 else 1 end end as consecutive_zeros, case when coalesce(hits, 0) > 0 then '2026-01-01T00:00:00Z' else lh end as last_hit_run from st full join r on st.query = r.query and st.source = r.source",
        "q_tiers": "with p as (select stat_id, row_number() over (order by hits_total desc, stat_id) rn, greatest(1, count(*) over () * 10 // 100) take from query_stats where hits_total > 0), t as (select q.stat_id, case when p.rn <= p.take then 'hot' when consecutive_zeros >= 3 then 'cold' else 'standard' end as tier from query_stats q left join p using (stat_id)) select stat_id, tier, case tier when 'hot' then 38 when 'cold' then 12 else 25 end as max_results from t",
        "q_sterile": _STERILE,
        "q_purge_cap": _STERILE + " order by pos limit 5",
        "q_actor_merge": f"select {_NA} as actor, arg_min(name, actor_id) as name, cast(sum(count) as bigint) as count, min(first_seen) as first_seen, max(last_seen) as last_seen, max(appearances_runs) as appearances_runs from discovered_actors where length({_NA}) between 3 and 200 group by 1",
        "q_promote": f"with k as (select distinct regexp_replace(lower(trim(term)), '\\s+', ' ', 'g') a from target_terms where list_name in ('companies', 'research_orgs')), c as (select actor_id, name, count, ' ' || lower(coalesce(name,'')) || ' ' as n, coalesce(sources, []) as src from discovered_actors where name is not null and count >= 5 and appearances_runs >= 2 and {_NA} not in (select a from k) order by count desc, actor_id limit 10) select actor_id, name, count, {_KIND} as kind from c",
        "q_score_distribution": f"select {_CAT} as category, count(*) as n, " + ", ".join(f"count(*) filter (score = {k}) as c{k}" for k in range(1, 6)) + f", round(count(*) filter (score in (4, 5)) / count(*), 6) as high_pct, round(count(*) filter (score = 5) / count(*), 6) as five_pct from article group by {_CAT}",
        "q_drift": "with r as (select batch_no, count(*) filter (score in (4,5)) / count(*) h, count(*) filter (score = 5) / count(*) f from article group by 1), w as (select batch_no, avg(f) over x f, avg(h) over x h, count(*) over x n from r window x as (order by batch_no rows between 2 preceding and current row)) select batch_no, case when n < 3 then null when f > 0.5 then 'over' when h < 0.05 then 'under' end as warning from w",
        "q_heatmap": "with c as (select user_id, cast(ts as date) run, count(*) n from events group by 1, 2), g as (select u.user_id, r.run, coalesce(n, 0) total from (select distinct user_id from events) u cross join (select distinct cast(ts as date) run from events) r left join c on c.user_id = u.user_id and c.run = r.run), a as (select *, coalesce(avg(total) over (partition by user_id order by run rows between 8 preceding and 1 preceding), 0.0) av from g) select run, user_id, total, round(av, 6) as avg, case when total < 2 then null when total / greatest(av, 0.5) >= 2 then 'up' when av >= 2 and total < 0.3 * av then 'down' end as anomaly from a",
        "q_bm25": f"with {_BM25} select pos, round(score, 5) as score from scored",
        "q_prerank_keep": f"with {_BM25}, x as (select a.pos, coalesce(round(s.score, 6), 0) as score from article a left join scored s using (pos)), y as (select pos, score / (select case when max(score) > 0 then max(score) else 1 end from x) as sim from x), z as (select pos, sim, row_number() over (order by sim desc, pos) rn, count(*) over () n from y) select pos from z where rn <= greatest(1, floor(n * 0.8)) or sim >= 0.05",
        "q_tfidf_terms": "with " + _vectors("title is not null", "title", r"[\pL\pN_]{2,}", 2000, 3, 0.6) + " select term, round(sum(w), 4) as weight, max(df) as df from v group by 1",
        "q_dedup_pairs": _PAIRS + " select a, b, round(cosine, 4) as cosine from pairs",
        "q_dedup_components": _COMP + " select node, root from comp",
        "q_semantic_dedup": _COMP + ", g as (select a.*, coalesce(c.root, a.pos) gr from article a left join comp c on c.node = a.pos), r as (select pos, row_number() over (partition by gr order by coalesce(category = 'patent', false) desc, length(coalesce(summary,'')) desc, coalesce(collected_at,'') desc, pos) n from g) select pos from r where n = 1",
        "q_embedding_cosine": "with q as (select embedding q from embeddings order by vec_id limit 1) select vec_id, round(list_cosine_similarity(cast(embedding as double[]), cast(q as double[])), 4) as cosine from embeddings, q",
        "q_judge_candidates": "select pos from article where score >= 4 or coalesce(confidence, 1.0) < 0.5 order by coalesce(confidence, 1.0), pos limit 50",
        "q_multi_judge": "select pos, case when pos % 7 = 0 then score when patent_assignee is not null then greatest(score, pos % 5 + 1) else cast(round_even((score + pos % 5 + 1) / 2.0, 0) as bigint) end as final, pos % 7 = 0 as judge_2_rejected from article where score is not null",
        "q_personalize": "with b as (select pos, score, lower(coalesce(title,'') || ' ' || coalesce(summary,'') || ' ' || array_to_string(coalesce(tags, []), ' ')) as b from article where score >= 2) select pos, round(score + 0.5 * least(3, len(list_filter(['solar','hardness','tin','fuel cells'], lambda w: contains(b, w)))) - 0.5 * least(3, len(list_filter(['withdraws','patent'], lambda w: contains(b, w)))), 2) as effective_score from b",
        "q_recap": "select count(*) as n, count(*) filter (score = 5) as n5, count(*) filter (score = 4) as n4 from article where score >= 2",
        "q_digest_groups": "select row_number() over (order by score desc, collected_at desc nulls last, pos) as rn, pos, score from (select * from article where score >= 4 order by score desc, collected_at desc nulls last, pos limit 100)",
        "q_dashboard_pivot": "select substr(coalesce(collected_at,''), 1, 10) as day, " + ", ".join(f"count(*) filter (score = {k}) as s{k}" for k in range(1, 6)) + " from article where score is not null group by 1",
        "q_dashboard_search": "select pos, substr(title, 1, 120) as title from article where score >= 4 and regexp_matches(title, '(?i)solar')",
        "q_ttl_cache": "select pos, published_at > timestamp '2025-08-01 00:00:00' - interval 60 days as fresh from article where patent_pub_num is not null and published_at is not null",
        "q_patent_candidates": f"select pos, patent_pub_num from article where {_CAT} = 'patent' and score >= 3 and length(patent_pub_num) > 0 order by score desc, pos limit 20",
        "q_querygen_gnews": f"select '\"' || c.term || '\" \"' || replace(k.term, 'Chemical Layer Deposition', 'Chemical Vapor Deposition') || '\"' as query from {tgt} c, {tgt} k where c.list_name = 'companies' and k.list_name = 'keywords' union select '\"' || term || '\"' from {tgt} where list_name = 'solo_keywords'",
        "q_querygen_all": _querygen(),
        "q_request_counts": f"with n as (select count(*) filter (list_name = 'companies') co, count(*) filter (list_name = 'keywords') kw, count(*) filter (list_name = 'solo_keywords') so, count(*) filter (list_name = 'research_orgs') org, count(*) filter (list_name = 'cross_domain_topics') cr from {tgt}), x as (select co * kw + so as news, kw + so + org + cr as e, org + cr as oc from n) select 5 as rss, e + 7 as arxiv, e + 6 as openalex, e + 8 as crossref, e + 6 as hal, e + 7 as semantic_scholar, e + 4 as web, e + 8 as patents, news as gnews, 350 + news * 5 + oc * 8 as raw_articles, greatest(3, cast(floor((350 + news * 5 + oc * 8) * 0.7 / 30) as bigint)) as batches, round(cast(case when news = 0 then 0 when news < 50 then news * 0.04 when news < 150 then news * 0.045 when news < 300 then news * 0.05 + 5 else news * 0.055 + 5 end as double), 6) as news_hours, round((1.0 + 1.0 + 350 * 0.7 / 30 * 0.5 + 5.0) / 60.0::double, 6) as other_hours from x",
        "q_most_active": f"with f as ({_FIRMS}), m as (select f.term, count(*) total from article a join f on contains({blob}, lower(f.term)) where trim({blob}) <> '' group by 1) select term, total from m order by total desc, term limit 10",
        "q_query_report": "select source, count(*) as queries, count(*) filter (hits_total > 0) as productive, count(*) filter (consecutive_zeros >= 4) as sterile, cast(sum(hits_total) as bigint) as hits from query_stats group by source",
        "q_top_queries": "with r as (select source, query, hits_total, row_number() over (partition by source order by hits_total desc nulls last, query nulls first, stat_id) as rank from query_stats) select source, rank, substr(query, 1, 80) as query, hits_total from r where rank <= 20",
        "q_report_lists": "(select 'productive' as kind, stat_id from query_stats where hits_total > 0 order by hits_total desc, stat_id limit 30) union all (select 'sterile', stat_id from query_stats where consecutive_zeros >= 4 order by consecutive_zeros desc, stat_id limit 30)",
        "q_feedback_counts": "select count(*) filter (lower(rating) = 'up') as up, count(*) filter (lower(rating) = 'down') as down from feedback",
        "q_digest_actors": "select actor_id, name, count from discovered_actors where count >= 2 order by count desc, actor_id limit 15",
        "q_dashboard_actors": "select actor_id, substr(coalesce(name,''), 1, 120) as name, count, appearances_runs from discovered_actors",
        "q_sorted_targets": f"select list_name, term, row_number() over (partition by list_name order by lower(term), term) as place from (select distinct list_name, term from {tgt})",
        "q_feedback_upsert": "with f as (select feedback_id, article_id, lower(trim(rating)) as rating, date, case when feedback_id % 3 = 0 then 1 else 0 end as late from feedback where length(article_id) > 0 and lower(trim(rating)) in ('up','down')), r as (select *, row_number() over (partition by article_id order by late desc, date desc nulls last, feedback_id desc) n from f) select feedback_id, article_id, rating from r where n = 1 order by date desc nulls last, feedback_id desc limit 500",
        "q_prompt_registry": "with p as (select substr(sha1(coalesce(text,'')), 1, 8) as version, fetched_at, length(coalesce(text,'')) as z, doc_id from documents) select version, min(fetched_at) as first_seen, min(z) as prompt_size from p where doc_id % 2 = 1 and version not in (select version from p where doc_id % 2 = 0) group by version",
        "q_archive_new": "with k as (select regexp_replace(trim(coalesce(link,'')), '/+$', '') as k, batch_no from article) select count(distinct k) as n from k where batch_no >= 1 and k <> '' and k not in (select k from k where batch_no = 0)",
        "q_memory_modes": f"with n as (select pos, {_url('link')} in (select {_url('link')} from article where batch_no = 0 and link is not null) as seen from article where batch_no >= 1) select 'filter' as mode, pos, false as was_seen from n where not seen union all select 'badge', pos, seen from n union all select 'reset', pos, false from n",
        "q_actor_runs": "with a as (select regexp_replace(lower(trim(patent_assignee)), '\\s+', ' ', 'g') as actor, split_part(coalesce(source,''), ' — ', 1) as source, case when batch_no = 0 then 0 else 1 end as run from article where length(trim(patent_assignee)) between 3 and 200), k as (select regexp_replace(lower(trim(term)), '\\s+', ' ', 'g') as actor from target_terms where list_name in ('companies', 'research_orgs')) select actor, count(*) as count, count(distinct run) as appearances_runs, string_agg(distinct source, ',' order by source) as sources from a where actor not in (select actor from k) group by actor",
        "q_calibration": "select batch_no, count(*) as n, count(*) filter (score = 5) as c5 from article group by 1 order by batch_no desc limit 5",
        "q_unread_mails": "select count(*) as n, max(feedback_id) as last_uid from feedback where feedback_id > 10",
        "q_translation": "with c as (select pos, summary from article where score >= 4 and trim(coalesce(summary,'')) <> '' order by pos limit 15) select pos, case when pos % 2 = 0 then upper(summary) end as summary_translated, case when pos % 2 = 0 then 'fr' end as summary_lang from c",
        "q_patent_families": "with a as (select pos, patent_pub_num, published_at from article where patent_pub_num is not null), c as (select patent_pub_num p, max(published_at) e, count(*) f, max(pos) z from a where published_at is not null group by 1), x as (select pos, z, f, coalesce(e > timestamp '2025-08-01 00:00:00' - interval 60 days, false) as fresh from a left join c on a.patent_pub_num = c.p) select pos, case when fresh then z end as epo_citations_count, case when fresh then f end as epo_family_size, not fresh as look_up from x",
        "q_term_examples": "with t as (select unnest(['hardness', 'solar', 'no such term']) as term), h as (select t.term, substr(coalesce(title,''), 1, 120) as title, row_number() over (partition by t.term order by pos) n, pos from article join t on contains(lower(coalesce(title,'') || ' ' || coalesce(summary,'')), t.term)) select t.term, coalesce(string_agg(title, ' / ' order by pos), '') as examples from t left join (select * from h where n <= 2) h using (term) group by t.term",
        "q_recap_order": "select pos, score from article where score >= 2 order by score desc, collected_at desc nulls last, pos limit 50",
    }
