"""SQL (DuckDB dialect) forms of the fixtures, used only by the SQL twins."""

from __future__ import annotations

#: view name -> (views it needs, body)
VIEWS: dict[str, tuple[str, str]] = {}


def view(name: str, body: str, needs: str = "") -> None:
    VIEWS[name] = (needs, body)


def with_views(names: str, body: str) -> str:
    """Prefix ``body`` with the named views and all they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for need in VIEWS[name][0].split():
                visit(need)
            order.append(name)

    for name in names.split():
        visit(name)
    if not order:
        return body
    parts = []
    for n in order:
        b = VIEWS[n][1].strip()
        # a recursive view gives its own column list as "(cols) AS ( ... )"
        parts.append(f"{n}{b}" if b.startswith("(") and ") AS" in b.split("\n")[0] else f"{n} AS MATERIALIZED ({b})")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


view("px", """
SELECT image_id, 'd' || (image_id % 3) AS dataset, image_id // 4 AS parent_id,
       CASE WHEN (image_id // 4) % 5 = 0 THEN 'val' WHEN (image_id // 4) % 5 = 1 THEN 'test' ELSE 'train' END AS split,
       height, width, CAST((slot // 4) * 8 + pos // 8 AS INTEGER) AS y, CAST((slot % 4) * 8 + pos % 8 AS INTEGER) AS x,
       label, CAST(least(99, greatest(0, floor((CAST(v AS DOUBLE) + 0.6::DOUBLE) * 100))) AS INTEGER) AS p100
FROM (SELECT *, CAST(8 * ((n + 3) // 4) AS INTEGER) AS height, CAST(8 * least(4, n) AS INTEGER) AS width,
             unnest(embedding) AS v, unnest(range(len(embedding))) AS pos
      FROM (SELECT vec_id // 16 AS image_id, vec_id % 16 AS slot, label, embedding,
                   count(*) OVER (PARTITION BY vec_id // 16) AS n FROM embeddings))
""")

view("truth", """
SELECT image_id, height, width, y, x FROM (
  SELECT *, lag(label) OVER h AS l, lead(label) OVER h AS r, lag(label) OVER v AS u, lead(label) OVER v AS d FROM px
  WINDOW h AS (PARTITION BY image_id, y ORDER BY x), v AS (PARTITION BY image_id, x ORDER BY y))
WHERE l <> label OR r <> label OR u <> label OR d <> label
""", "px")

view("prob_px", """
SELECT px.*, t.image_id IS NOT NULL AS "true" FROM px LEFT JOIN truth t USING (image_id, y, x)
""", "px truth")

view("tiles", """
SELECT o_orderkey AS tile_id, o_orderpriority AS dataset, o_custkey % 97 AS parent_id,
       CAST(o_orderkey % 1000 AS DOUBLE) / 10000 AS outline_fraction FROM orders
""")

view("files", """
SELECT source AS dataset, '/data/' || source || '/images/' || doc_id || '.png' AS path FROM documents
UNION ALL
SELECT source, '/data/' || source || '/masks/' || doc_id || '_mask.png' FROM documents
WHERE doc_id IN (SELECT doc_id FROM labels)
""")

view("scores", """
SELECT d.doc_id, d.lang AS dataset, CAST(d.n_chars % 100 AS INTEGER) AS p100, l.quality = 1 AS "true"
FROM documents d JOIN labels l USING (doc_id)
""")

view("history", """
SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch,
       value AS score, event_type FROM events
""")

view("image_sizes", """
SELECT p_partkey AS image_id, 'img' || p_partkey AS stem, p_brand AS dataset,
       CAST(200 + p_partkey % 900 AS INTEGER) AS width, CAST(200 + p_size * 17 AS INTEGER) AS height FROM part
""")

view("grid", "SELECT CAST(5 * i AS INTEGER) AS t100, CAST(5 * i AS DOUBLE) / 100 AS threshold FROM range(1, 20) r(i)")

view("disk2", "SELECT dy, dx FROM range(-2, 3) a(dy), range(-2, 3) b(dx) WHERE dy * dy + dx * dx <= 4")

view("near2", """
SELECT p.image_id, p.dataset, p.y, p.x, p.p100, p."true", max(q.p100) AS near100, bool_or(q."true") AS true_near
FROM prob_px p, disk2 o, prob_px q WHERE q.image_id = p.image_id AND q.y = p.y + o.dy AND q.x = p.x + o.dx
GROUP BY ALL
""", "prob_px disk2")

view("counters", """
SELECT n.dataset, g.threshold,
       count(*) FILTER ("true" AND p100 >= t100) AS tp, count(*) FILTER (p100 >= t100) AS n_pred,
       count(*) FILTER (true_near AND p100 >= t100) AS hits_p, count(*) FILTER ("true" AND near100 >= t100) AS hits_r,
       count(DISTINCT image_id) AS tiles, count(*) AS total_px, count(*) FILTER ("true") AS true_px,
       min(p100) AS pmin, max(p100) AS pmax, sum(p100) AS psum
FROM near2 n, grid g GROUP BY 1, 2
""", "near2 grid")



def ratio(num: str, den: str, places: int = 6) -> str:
    return f"round(CASE WHEN ({den}) > 0 THEN CAST({num} AS DOUBLE) / ({den}) ELSE 0.0 END, {places})"
