"""The core queries as SQL for an independent check by another engine."""

from __future__ import annotations

from geoloom.functions.geo import _ALPHA, _BETA, _DELTA, _N, _RECT, METRES_PER_PIXEL_Z0, UTM_K0

GEO = """geo as (select cast(vec_id + 1 as bigint) as id, concat('16SBH', lpad(cast(vec_id as varchar), 5, '0'), lpad(cast(vec_id as varchar), 5, '0')) as tile_id,
  embedding, label, -86.5e0 + (vec_id % 25) * 1e-2 as lon, 33.0e0 + floor(vec_id / 25.0e0) * 1e-2 as lat from embeddings)"""
LAB = GEO + ", lab as (select id, embedding, 1 - label as y, lon, lat from geo where label in (0, 1))"
EXPLODED = "select id, y, generate_subscripts(embedding, 1) - 1 as pos, cast(unnest(embedding) as double) as v from lab"
QV = LAB + f""", qv as (select pos, 2 * avg(v) filter (where y = 1) - coalesce(avg(v) filter (where y = 0), 0) as value from ({EXPLODED}) group by pos),
q as (select list(value order by pos) as q from qv)"""
HITS = QV + """, hits as (select id, list_distance(cast(embedding as double[]), q) as distance, row_number() over (order by list_distance(cast(embedding as double[]), q), id) as rank
  from geo, q where id not in (select id from lab) order by distance, id limit 200)"""
USABLE = """stored as (select id, cast(embedding as double[]) as e from geo_embeddings where len(embedding) = 64
  and len(list_filter(embedding, lambda x: isfinite(x))) = 64 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
  one as (select e as q from stored order by id limit 1)"""
TILE = "nullif(regexp_replace(replace(upper(trim(regexp_replace(tile_id, '\\s+', ' ', 'g'))), '-', '_'), '(^|_)0+([0-9])', '\\1\\2', 'g'), '')"
CLASS = "coalesce(nullif(regexp_replace(lower(trim(class)), '[-\\s_]+', '_', 'g'), ''), 'unknown')"
REGION = "regexp_replace(lower(trim(region_name)), '[-\\s_]+', '_', 'g')"
ONCE = """ev as (select seq, session_id, point_id, label from (select *, row_number() over (partition by seq order by arrived_at, point_id, label) as rn
  from label_events where label is not null and seq is not null) where rn = 1)"""


def utm(lon: str, lat: str, zone: str) -> tuple[str, str]:
    """Easting and northing (north) by the Krueger series."""
    c = 2 * _N**0.5 / (1 + _N)
    s = f"sin(radians({lat}))"
    t = f"sinh(atanh({s}) - {c!r} * atanh({c!r} * {s}))"
    dl = f"radians({lon} - ({zone} * 6 - 183))"
    xi, eta = f"atan2({t}, cos({dl}))", f"atanh(sin({dl}) / sqrt(1 + {t} * {t}))"
    e = eta + "".join(f" + {a!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(_ALPHA, 1))
    n = xi + "".join(f" + {a!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(_ALPHA, 1))
    k = UTM_K0 * _RECT
    return f"(500000.0 + {k!r} * ({e}))", f"({k!r} * ({n}))"


def utm_back(e: str, n: str) -> tuple[str, str]:
    """Longitude minus the zone's middle, and latitude."""
    k = UTM_K0 * _RECT
    xi, eta = f"(({n}) / {k!r})", f"((({e}) - 500000.0) / {k!r})"
    x2 = "(" + xi + "".join(f" - {b!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, b in enumerate(_BETA, 1)) + ")"
    e2 = "(" + eta + "".join(f" - {b!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, b in enumerate(_BETA, 1)) + ")"
    chi = f"asin(sin({x2}) / cosh({e2}))"
    lat = chi + "".join(f" + {d!r} * sin({2 * j} * {chi})" for j, d in enumerate(_DELTA, 1))
    return f"degrees(atan2(sinh({e2}), cos({x2})))", f"degrees({lat})"


_ZONE = "least(60, greatest(1, cast(floor(({lon} + 180) / 6) as int) + 1))"
_E, _NO = utm("lon", "lat", "zone")
_PE, _PN = utm("p_lon", "p_lat", "zone")


def _nearest(shift: str, first: str, retry: str | None) -> str:
    base = f"""with {GEO}, p as (select id as pid, lon + {shift} as p_lon, lat + {shift} / 2 as p_lat, least(60, greatest(1, cast(floor((lon + {shift} + 180) / 6) as int) + 1)) as zone from geo where label = 3),
      pu as (select *, {_PE} as pe, {_PN} as pn from p), t as (select * from geo where label <> 3),
      j as (select pid, tile_id, sqrt(power(pe - {_E}, 2) + power(pn - {_NO}, 2)) as d, (lon - p_lon) * (lon - p_lon) + (lat - p_lat) * (lat - p_lat) as deg2 from pu, t),
      a as (select pid, tile_id, d from (select *, row_number() over (partition by pid order by d, tile_id) as rn from j where {first}) where rn = 1)"""
    if retry is None:
        return base + ", m as (select * from a)"
    return base + f""", b as (select pid, tile_id, d from (select *, row_number() over (partition by pid order by d, tile_id) as rn from j
      where {retry} and pid not in (select pid from a)) where rn = 1), m as (select * from a union all select * from b)"""


_IN5, _IN20 = "deg2 <= 0.005 * 0.005e0", "deg2 <= 0.02 * 0.02e0"
_LASSO = [(-86.497, 33.003), (-86.402, 33.011), (-86.317, 33.113), (-86.431, 33.187), (-86.483, 33.091)]
_ODD = " + ".join(
    f"case when ({y1}e0 > lat) <> ({y2}e0 > lat) and lon < ({x2}e0 - {x1}e0) * (lat - {y1}e0) / ({y2}e0 - {y1}e0) + {x1}e0 then 1 else 0 end"
    for (x1, y1), (x2, y2) in zip([(repr(a), repr(b)) for a, b in _LASSO], [(repr(a), repr(b)) for a, b in _LASSO[1:] + _LASSO[:1]])
)
_A, _F = 6378137.0, 1 / 298.257223563
_E2 = _F * (2 - _F)


def _ecef(lon: str, lat: str) -> tuple[str, str, str]:
    n = f"({_A!r} / sqrt(1 - {_E2!r} * sin(radians({lat})) * sin(radians({lat}))))"
    return f"{n} * cos(radians({lat})) * cos(radians({lon}))", f"{n} * cos(radians({lat})) * sin(radians({lon}))", f"{n} * {1 - _E2!r} * sin(radians({lat}))"


_X, _Y, _Z = _ecef("lon", "lat")
XYZ = f"xyz as (select *, {_X} as x, {_Y} as y, {_Z} as z from geo)"
_DIST2 = "power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)"
CLUSTERS = f"""with recursive {GEO}, {XYZ}, pos as (select * from xyz where label = 0),
  edge as (select a.id as u, b.id as v from pos a, pos b where {_DIST2} <= 1000.0 * 1000.0),
  reach(u, v) as (select u, v from edge union select r.u, e.v from reach r join edge e on r.v = e.u),
  cl as (select u as id, min(v) as cluster from reach group by u)"""
FOLDS = CLUSTERS + f""", sizes as (select cluster, count(*) as n, row_number() over (order by count(*) desc, cluster) as r from cl group by cluster),
  deal(r, cluster, load, fold) as (
    select cast(0 as bigint), cast(-1 as bigint), [0::bigint, 0, 0, 0, 0], -1
    union all
    select s.r, s.cluster, list_transform(d.load, lambda v, i: case when i = list_position(d.load, list_min(d.load)) then v + s.n else v end), list_position(d.load, list_min(d.load)) - 1
    from deal d join sizes s on s.r = d.r + 1),
  pf as (select cl.id, deal.fold from cl join deal on deal.cluster = cl.cluster where deal.r > 0),
  nf as (select id, fold from (select a.id, pf.fold, row_number() over (partition by a.id order by round(sqrt({_DIST2}), 6), b.id) as rn from xyz a, pos b join pf on pf.id = b.id where a.label = 1) where rn = 1),
  folds as (select id, 1 as label, fold from pf union all select id, 0 as label, fold from nf)"""
SCORED = GEO + ", s as (select id, case when label < 5 then 1 else 0 end as label, round(0.5e0 + cast(embedding[1] as double), 3) as p, id % 5 as fold from geo)"
METRICS = """count(*) filter (where label = 1 and p >= 0.5) as tp, count(*) filter (where label = 0 and p >= 0.5) as fp,
  count(*) filter (where label = 1 and p < 0.5) as fn, count(*) filter (where label = 0 and p < 0.5) as tn"""
DETBOX = """d as (select detection_id, list_transform(regexp_extract_all(geometry, '(-?[0-9.]+) (-?[0-9.]+)', 0), lambda s: cast(split_part(s, ' ', 1) as double)) as xs,
  list_transform(regexp_extract_all(geometry, '(-?[0-9.]+) (-?[0-9.]+)', 0), lambda s: cast(split_part(s, ' ', 2) as double)) as ys from detections),
  box as (select detection_id, list_min(xs) as west, list_max(xs) as east, list_min(ys) as south, list_max(ys) as north, xs, ys from d)"""
PIX = "px as (select cast(user_id % 40 as int) as x, cast(floor(user_id / 40.0) % 25 as int) as y, ts as t, value, cast(event_id % 100 as int) as qa, event_id from events)"
_CORNER = []
for _i, (_dx, _dy) in enumerate(((1, -1), (1, 1), (-1, 1), (-1, -1))):
    _bx, _by = utm_back(f"ue + {_dx * 160.0}", f"un + {_dy * 160.0}")
    _CORNER.append(f"select id, {_i} as corner, round({_bx} + (zone * 6 - 183), 7) as x, round({_by}, 7) as y from u")
_SX, _SY = "((lon + 180) / 360 * 16384.0)", "((1 - ln(tan(radians(lat)) + sqrt(1 + tan(radians(lat)) * tan(radians(lat)))) / pi()) / 2 * 16384.0)"
_EDGE = "degrees(atan(sinh(pi() * (1 - 2 * ({y}) / 16384.0))))"

ORACLE_SQL: dict[str, str] = {
    "search_topk": f"with {HITS} select h.id, g.tile_id, round(h.distance, 6) as distance, h.rank from hits h join geo g using (id) where rank <= 20",
    "query_vector": f"with {QV} select pos, round(value, 6) as value from qv",
    "topk_l2": f"with {USABLE} select id, round(list_distance(e, q), 5) as distance from stored, one order by list_distance(e, q), id limit 1000",
    "topk_cosine": f"with {USABLE} select id, round(1 - list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q))), 5) as distance from stored, one order by 1 - list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q))), id limit 1000",
    "search_overfetch": f"""with {QV}, n as (select count(*) as n from lab), got as (select id, power(list_distance(cast(embedding as double[]), q), 2) as distance,
      row_number() over (order by power(list_distance(cast(embedding as double[]), q), 2), id) as r from geo, q),
      kept as (select id, distance, row_number() over (order by distance, id) as rank from got, n where r <= 100 + least(n.n, 50) and id not in (select id from lab))
      select id, round(distance, 6) as distance, rank from kept where rank <= 100""",
    "highlight_cutoff": f"with {HITS}, n as (select count(*) as n from hits) select round(max(distance) filter (where rank <= greatest(1, least(100, ceil(0.1 * n)))), 6) as cutoff, round(min(distance), 6) as low, round(max(distance), 6) as high from hits, n",
    "color_fraction": f"""with {HITS}, n as (select count(*) as n from hits), c as (select max(distance) filter (where rank <= greatest(1, least(100, ceil(0.1 * n)))) as c, min(distance) as lo, max(distance) as hi from hits, n)
      select id, round(case when hi <= lo then 0.5 when c > lo then case when distance <= c then 0.7 + 0.3 * (1 - greatest(0, least(1, (distance - lo) / (c - lo)))) else greatest(0, 0.7 - 0.7 * greatest(0, least(1, (distance - c) / (hi - c)))) end
      else 1 - greatest(0, least(1, (distance - lo) / (hi - lo))) end, 5) as fraction from hits, c""",
    "page_slice": f"with {HITS} select cast(case when rank <= 20 then 0 else ceil((rank - 20) / 50.0) end as int) as page, rank, id from hits where rank <= 170",
    "dissimilar_order": f"with {HITS} select id, row_number() over (order by distance desc, id desc) as position from hits",
    "probability_fraction": "select detection_id, round((coalesce(probability, 0.5) - min(coalesce(probability, 0.5)) over ()) / (max(coalesce(probability, 0.5)) over () - min(coalesce(probability, 0.5)) over ()), 6) as fraction from detections where probability is null or probability between 0 and 1",
    "embedding_dims": "select len(embedding) as dim, count(*) as n from geo_embeddings group by 1",
    "sq8_quantize": f"""with {GEO}, e as (select id, generate_subscripts(embedding, 1) - 1 as pos, cast(unnest(embedding) as double) as v from geo), r as (select pos, min(v) as lo, max(v) as hi from e group by pos)
      select id, pos, cast(case when hi > lo then floor((v - lo) / (hi - lo) * 255 + 0.5) else 0 end as int) as code from e join r using (pos)""",
    "mean_by_label": f"with {GEO}, e as (select label, generate_subscripts(embedding, 1) - 1 as pos, cast(unnest(embedding) as double) as v from geo) select label, pos, round(avg(v), 6) as mean from e group by 1, 2",
    "id_lookup": "select id, tile_id, scene_id from geo_embeddings where id in (select try_cast(id as bigint) from labeled)",
    "metadata_join": "select d.id, d.detection_id, d.probability, g.tile_id, g.model_name from detections d join geo_embeddings g using (id)",
    "label_embedding_join": "select l.feature_id, try_cast(l.id as bigint) as id, l.label, len(g.embedding) as dim from labeled l left join geo_embeddings g on g.id = try_cast(l.id as bigint)",
    "missing_embeddings": "select distinct try_cast(id as bigint) as id from labeled where try_cast(id as bigint) is not null and try_cast(id as bigint) not in (select id from geo_embeddings where embedding is not null)",
    "exclude_ids": f"with l as (select {TILE} as t from labeled), g as (select id, {TILE} as t from geo_embeddings) select id, t from g where not exists (select 1 from l where l.t = g.t)",
    "external_id": "select id, coalesce(tile_id, cast(id as varchar)) as display from geo_embeddings",
    "tile_keys": f"select tile, count(*) as n, min(id) as first_id from (select id, {TILE} as tile from geo_embeddings) where tile is not null group by 1 having count(*) > 1",
    "mgrs_parts": f"""with t as (select {TILE} as t from geo_embeddings), m as (select regexp_extract(t, '^([0-9]{{1,2}})([C-HJ-NP-X])([A-Z]{{2}})', ['zone', 'band', 'square']) as m from t where regexp_matches(t, '^([0-9]{{1,2}})([C-HJ-NP-X])([A-Z]{{2}})'))
      select cast(m.zone as int) as zone, m.band as band, m.square as square, case when m.band >= 'N' then 32600 else 32700 end + cast(m.zone as int) as epsg, count(*) as n from m where cast(m.zone as int) between 1 and 60 group by all""",
    "class_counts": f"select {CLASS} as class, count(*) as n from labeled group by 1",
    "label_counts": "select coalesce(source, 'manual') as source, count(*) as total, count(*) filter (where label = 1) as positives, count(*) filter (where label = 0) as negatives from labeled group by 1",
    "correction_weights": f"select dataset_id, sum(case when {CLASS} in ('relabel_pos', 'relabel_neg') then 3.0e0 else 1.0e0 end) as weight, count(*) as n from labeled where label in (0, 1) group by 1",
    "union_datasets": "select class, count(*) as n, count(label) as labelled, count(distinct id) as ids from (select id, label, coalesce(class, 'unknown') as class from labeled union all select cast(id as varchar), null, coalesce(class, 'unknown') from detections) group by 1",
    "augmented_labels": """with u as (select 'manual' as source, label, case when label = 1 then 'manual_pos' else 'manual_neg' end as class from labeled where label in (0, 1)
      union all select 'detection_review', case when probability >= 0.5 then 1 else 0 end, case when probability >= 0.5 then 'relabel_pos' else 'relabel_neg' end from detections where probability between 0 and 1)
      select source, class, count(*) as total, count(*) filter (where label = 1) as positives, count(*) filter (where label = 0) as negatives from u group by 1, 2""",
    "surrogate_key": "select id as source_id, scene_id, geometry, row_number() over (order by id) as row_no from geo_embeddings",
    "distinct_scenes": "select distinct coalesce(scene_id, '') as scene_id, coalesce(model_name, '') as model_name from geo_embeddings",
    "utm_project": f"with {GEO}, u as (select *, {_ZONE.format(lon='lon')} as zone from geo) select id, round({_E}, 3) as easting, round({_NO}, 3) as northing from u",
    "utm_zone_epsg": f"with {GEO} select id, {_ZONE.format(lon='lon')} as zone, 32600 + {_ZONE.format(lon='lon')} as epsg from geo",
    "nearest_point": f"with {GEO} select id, tile_id, round(sqrt(power(lon + 86.4333e0, 2) + power(lat - 33.0871e0, 2)), 6) as distance_deg from geo order by sqrt(power(lon + 86.4333e0, 2) + power(lat - 33.0871e0, 2)), id limit 1",
    "nearest_tile_join": _nearest("0.0031e0", "true", None) + " select pid, tile_id, round(d, 3) as distance_m from m",
    "nearest_tile_buffered": _nearest("0.0061e0", _IN5, None) + " select pid, tile_id, round(d, 3) as distance_m from m",
    "nearest_retry": _nearest("0.0061e0", _IN5, _IN20) + " select pid, tile_id, round(d, 3) as distance_m from m",
    "match_stats": _nearest("0.0061e0", _IN5, _IN20) + " select count(*) as n, round(avg(d), 3) as mean_m, round(max(d), 3) as max_m, count(*) filter (where d > 500) as far from m",
    "points_in_polygon": f"with {GEO} select id, tile_id from geo where ({_ODD}) % 2 = 1",
    "points_in_ring": f"with {GEO} select id, tile_id from geo where ({_ODD}) % 2 = 1",
    "box_tile_intersect": f"with {GEO} select id from geo where lon - 0.002e0 <= -86.4e0 and lon + 0.002e0 >= -86.45e0 and lat - 0.002e0 <= 33.1e0 and lat + 0.002e0 >= 33.05e0",
    "filter_near_positives": f"with {GEO}, {XYZ} select id, tile_id from xyz a where label <> 0 and not exists (select 1 from xyz b where b.label = 0 and {_DIST2} <= 1500.0 * 1500.0)",
    "tile_polygon_corners": f"with {GEO}, z as (select *, {_ZONE.format(lon='lon')} as zone from geo), u as (select id, zone, {_E} as ue, {_NO} as un from z) " + " union all ".join(_CORNER),
    "detection_boxes": f"with {DETBOX} select detection_id, west, east, south, north, round((xs[1] + xs[2] + xs[3] + xs[4]) / 4, 6) as cx, round((ys[1] + ys[2] + ys[3] + ys[4]) / 4, 6) as cy from box",
    "detection_threshold": "select coalesce(class, 'unknown') as class, count(*) as n, min(probability) as low, max(probability) as high from detections where coalesce(probability, 0.0) between 0.5 and 1 group by 1",
    "detection_tiles": f"with d as (select detection_id, {TILE} as tile, probability from detections where probability between 0.5 and 1), g as (select {TILE} as tile, id from geo_embeddings) select d.tile, d.detection_id, d.probability, s.first_id, s.stored from d join (select tile, min(id) as first_id, count(*) as stored from g where tile is not null group by 1) s on s.tile = d.tile",
    "dissolve_components": f"""with recursive {DETBOX}, edge as (select a.detection_id as u, b.detection_id as v from box a, box b where a.west <= b.east and b.west <= a.east and a.south <= b.north and b.south <= a.north),
      reach(u, v) as (select u, v from edge union select r.u, e.v from reach r join edge e on r.v = e.u), c as (select u, min(v) as component from reach group by u) select component, count(*) as squares from c group by 1""",
    "chip_grid": """with s as (select concat('16SB', substr(n_name, 1, 1)) as mgrs_id, min(n_nationkey) * 1000.0e0 + 500000 as x0, min(n_nationkey) * 2000.0e0 + 3600000 as y0 from nation group by 1),
      g as (select mgrs_id, x0, y0, unnest(range(cast(round_even(3250 / 160.0, 0) as bigint) + 1)) as i from s), h as (select *, unnest(range(cast(round_even(2410 / 160.0, 0) as bigint) + 1)) as j from g)
      select concat(mgrs_id, '_32_16_10_', j, '_', i) as tile_id, x0 + i * 160.0 as cx, y0 + j * 160.0 as cy from h where x0 + i * 160.0 - 160 <= x0 + 3250 and y0 + j * 160.0 - 160 <= y0 + 2410""",
    "image_windows": """with i as (select p_partkey as image, cast(p_size * 20 + 100 as int) as h, cast(p_size * 10 + 300 as int) as w from part), r as (select *, unnest(range(0, h - 1, 168)) as r from i), c as (select *, unnest(range(0, w - 1, 168)) as c from r)
      select image, count(*) as n, cast(sum(least(224, h - r)) as bigint) as heights, cast(sum(least(224, w - c)) as bigint) as widths from c group by 1""",
    "slippy_tile": f"with {GEO} select id, cast(floor({_SX}) as bigint) as x, cast(floor({_SY}) as bigint) as y, round({_SX}, 4) as fx, round({_SY}, 4) as fy from geo",
    "tile_center": f"with {GEO}, t as (select id, floor({_SX}) as x, floor({_SY}) as y from geo) select id, concat('14_', cast(x as bigint), '_', cast(y as bigint)) as tile, round((x + 0.5) / 16384.0 * 360 - 180, 6) as lon, round(({_EDGE.format(y='y')} + {_EDGE.format(y='y + 1')}) / 2, 6) as lat from t",
    "zoom_for_coverage": f"with {GEO} select id, case when id % 97 > 0 then cast(least(22, greatest(0, round_even(log2({METRES_PER_PIXEL_Z0} * cos(radians(lat)) / (40.0e0 * (id % 97) / 256)), 0))) as int) end as zoom from geo",
    "metres_per_pixel": f"with {GEO} select id, round({METRES_PER_PIXEL_Z0} * cos(radians(lat)) / power(2.0e0, id % 20), 6) as mpp from geo",
    "neighbour_tiles": "with t as (select cast(n_nationkey as int) as x, cast(n_nationkey % 8 as int) as y from nation) select x, y, cast((x + dx + 32) % 32 as bigint) as nx, cast(y + dy as bigint) as ny from t, (values (-1), (0), (1)) a(dx), (values (-1), (0), (1)) b(dy) where y + dy between 0 and 31",
    "geo_to_pixel": f"with {GEO} select id, round((lon + 86.6e0) / (-86.2e0 + 86.6e0) * 800, 4) as col, round((34.1e0 - lat) / (34.1e0 - 32.9e0) * 600, 4) as row from geo",
    "stratified_split": f"""with {GEO}, c as (select id, concat('c', label) as class, case when label < 3 then 1 else 0 end as y from geo), n as (select class, y, count(*) as n from c group by 1, 2), m as (select min(n) as m from n where y = 0),
      r as (select c.id, c.class, c.y, n.n, row_number() over (partition by c.class order by md5(concat('42_', c.id)), c.id) as r from c join n using (class))
      select id, class, case when r <= case when y = 1 then greatest(1, floor(n * 0.2e0)) else greatest(1, floor(m * 0.2e0)) end then 'test' else 'train' end as part from r, m""",
    "spatial_clusters": CLUSTERS + " select id, cluster from cl",
    "spatial_folds": FOLDS + " select id, label, cast(fold as int) as fold from folds",
    "fold_counts": FOLDS + " select cast(fold as int) as fold, count(*) filter (where label = 1) as test_pos, count(*) filter (where label = 0) as test_neg from folds group by 1 having count(distinct label) = 2",
    "random_negatives": f"with {GEO}, {XYZ} select id, tile_id, 0 as label, 'random_neg' as class from xyz a where label <> 0 and not exists (select 1 from xyz b where b.label = 0 and {_DIST2} <= 1200.0 * 1200.0) order by md5(concat('42_', tile_id)), tile_id limit 40",
    "lulc_stratified": f"""with {GEO}, w(land, n, name) as (values (2, 5, 'trees'), (4, 5, 'flooded_vegetation'), (5, 2, 'crops'), (6, 2, 'shrub'), (9, 3, 'snow')), r as (select id, cast(label as int) as land, row_number() over (partition by label order by md5(concat('42_', id)), id) as r from geo)
      select r.id, r.land, w.name from r join w using (land) where r.r <= w.n""",
    "classifier_metrics": f"with {SCORED}, m as (select {METRICS} from s) select tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1 from m",
    "roc_auc": f"with {SCORED}, r as (select label, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as r from s) select round((sum(r) filter (where label = 1) - count(*) filter (where label = 1) * (count(*) filter (where label = 1) + 1) / 2.0) / (count(*) filter (where label = 1) * count(*) filter (where label = 0)), 6) as auc from r",
    "cv_mean_std": f"with {SCORED}, m as (select fold, {METRICS} from s group by fold), f as (select (tp + tn) / (tp + fp + fn + tn) as accuracy, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as f1 from m) select round(avg(accuracy), 6) as accuracy_mean, round(stddev_pop(accuracy), 6) as accuracy_std, round(avg(f1), 6) as f1_mean, round(stddev_pop(f1), 6) as f1_std from f",
    "label_fold": f"""with {ONCE}, l as (select session_id, point_id, list(label order by seq) as ls from ev group by 1, 2),
      f as (select session_id, point_id, list_reduce(list_prepend(-100, ls), lambda st, x: case when x = -100 or x = st then -100 else x end) as label from l) select session_id, point_id, label from f where label <> -100""",
    "label_last_wins": f"with {ONCE} select session_id, point_id, label from (select *, row_number() over (partition by session_id, point_id order by seq desc) as rn from ev) where rn = 1 and label <> -100",
    "epoch_reset": f"""with {ONCE}, r as (select session_id, max(seq) filter (where coalesce(try_cast(point_id as bigint) % 50 = 0, false)) as reset from ev group by 1)
      select session_id, point_id, label from (select e.*, row_number() over (partition by e.session_id, point_id order by seq desc) as rn from ev e join r on r.session_id is not distinct from e.session_id where e.session_id is not null and (reset is null or seq > reset)) where rn = 1 and label <> -100""",
    "session_labels": f"with {ONCE}, l as (select session_id, point_id, label from (select *, row_number() over (partition by session_id, point_id order by seq desc) as rn from ev) where rn = 1 and label <> -100) select session_id, count(*) as total, count(*) filter (where label = 1) as positives, count(*) filter (where label = 0) as negatives from l group by 1",
    "tile_spec_parse": """with m as (select distinct trim(model_name) as model_name, regexp_replace(regexp_replace(trim(model_name), '\\.(db|duckdb|index|faiss|parquet|tar\\.gz)$', ''), '_metadata$', '') as s from manifest)
      select model_name, try_cast(regexp_extract(s, '(\\d+)_(\\d+)_(\\d+(?:\\.\\d+)?)$', 1) as int) as size_px, try_cast(regexp_extract(s, '(\\d+)_(\\d+)_(\\d+(?:\\.\\d+)?)$', 2) as int) as overlap_px, try_cast(regexp_extract(s, '(\\d+)_(\\d+)_(\\d+(?:\\.\\d+)?)$', 3) as double) as resolution from m""",
    "manifest_catalog": f"select concat({REGION}, ' / ', trim(model_name)) as display_name, case when trim(model_path) like 's3://%' then 's3' when trim(model_path) like 'gs://%' then 'gs' end as protocol, regexp_replace(trim(model_path), '^s3://([^/]+)/', 'https://\\1.s3.amazonaws.com/') as url, regexp_matches(lower(trim(model_name)), '_\\d+$') as numbered from manifest",
    "manifest_regions": f"with m as (select {REGION} as region, count(distinct trim(model_name)) as models from manifest group by 1), r as (select region_id, {REGION} as region from roi_areas) select region_id, r.region, models from r join m using (region)",
    "format_size": """with d as (select doc_id, cast(n_chars * n_chars * 37 as double) as n from documents) select doc_id, case when n is null then 'unknown' when n < 1024 then printf('%.1f B', n) when n < 1048576 then printf('%.1f KB', n / 1024)
      when n < 1073741824 then printf('%.1f MB', n / 1048576) when n < 1099511627776 then printf('%.1f GB', n / 1073741824) else printf('%.1f TB', n / 1099511627776) end as size from d""",
    "sha_key": f"select {REGION} as region, sha256(string_agg(trim(model_path), chr(10) order by trim(model_path))) as key from manifest group by 1",
    "geojson_roundtrip": f"with {GEO} select id, tile_id, cast(label as double) as label, 'unknown' as class, 'Point' as geometry_type from geo",
    "median_composite": f"with {PIX} select x, y, round(median(value), 6) as median from px where qa >= 60 and value is not null group by 1, 2",
    "latest_mosaic": f"with {PIX} select x, y, value from (select *, row_number() over (partition by x, y order by t desc, event_id desc, value desc) as rn from px where value is not null) where rn = 1",
    "normalized_difference": "select l_suppkey, round(avg((l_extendedprice - l_quantity * 900) / nullif(l_extendedprice + l_quantity * 900, 0)), 6) as ndvi, count(*) as n from lineitem group by 1",
    "rgb_to_hsv": """with p as (select p_partkey, (p_partkey * 7) % 10001 / 10000.0e0 as r, (p_partkey * 131) % 10001 / 10000.0e0 as g, (p_partkey * 1009) % 10001 / 10000.0e0 as b from part), q as (select *, greatest(r, g, b) as hi, greatest(r, g, b) - least(r, g, b) as d from p)
      select p_partkey, round((case when d = 0 then 0 when hi = r then ((g - b) / d + 6) - 6 * floor(((g - b) / d + 6) / 6) when hi = g then (b - r) / d + 2 else (r - g) / d + 4 end) / 6, 6) as h, round(case when hi > 0 then d / hi else 0 end, 6) as s, round(hi, 6) as v from q""",
    "morph_close": f"""with {PIX}, m as (select x, y, max(case when qa > 92 then 1 else 0 end) as v from px group by 1, 2), d as (select a.x, a.y, max(b.v) as v from m a join m b on abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 group by 1, 2)
      select a.x, a.y, min(b.v) as v from d a join d b on abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 group by 1, 2""",
}
