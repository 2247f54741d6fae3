"""SQL of the operators whose queries take more than a few lines of it: centroid clustering and conversation repair."""

from __future__ import annotations


def centroids(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds, every distance anew."""

    def assigned(i: int) -> str:
        return f"""
        a{i} AS (SELECT n, c, d FROM (
            SELECT kept.n, c{i}.c, list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept, c{i})
            QUALIFY row_number() OVER (PARTITION BY n ORDER BY d, c) = 1)"""

    def moved(i: int) -> str:
        return f"""
        s{i} AS (SELECT c, p, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x
            FROM (SELECT a{i}.c, unnest(kept.v) AS x, unnest(range(64)) AS p FROM a{i} JOIN kept USING (n)) GROUP BY c, p),
        m{i} AS (SELECT c, list(x ORDER BY p) AS v FROM s{i} GROUP BY c),
        c{i + 1} AS (SELECT c{i}.c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} ON c{i}.c = m{i}.c)"""

    steps = ",".join(assigned(i) + "," + moved(i) for i in range(rounds))
    return f"""
        WITH kept AS (
            SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
        c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {k})),
        {steps},
        {assigned(rounds)}
        SELECT vec_id, CAST(a{rounds}.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.c) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN kept USING (n) JOIN c{rounds} ON a{rounds}.c = c{rounds}.c"""


def conversations() -> str:
    """The same costs from the last row back, with whole audits instead of checkpoints; CRC-32 bit by bit, as SQL has none."""
    after = ((2, 3, 0), (0, 3, 0), (0, 0, 4), (0, 3, 0))  # states 1 to 4; 0: none
    following = (3, 3, 4, 3)

    def row(q: int) -> str:
        kept = " ".join(f"WHEN letter = '{letter}' THEN {{'c': t + v[{to}].c, 'a': 'K' || v[{to}].a}}" for letter, to in zip("sua", after[q], strict=True) if to)
        to = following[q]
        return (
            f"list_min(list_filter([{{'c': 4 + v[{q + 1}].c, 'a': 'D' || v[{q + 1}].a}}, CASE WHEN must THEN NULL {kept} END, "
            f"CASE WHEN must THEN NULL ELSE {{'c': 3 + t + v[{to}].c, 'a': 'R' || v[{to}].a}} END], lambda x: x IS NOT NULL))"
        )

    def inserted(q: int) -> str:
        one = following[q]
        two = following[one - 1]
        return f"list_min([w[{q + 1}], {{'c': 3 + w[{one}].c, 'a': 'I' || w[{one}].a}}, {{'c': 6 + w[{two}].c, 'a': 'II' || w[{two}].a}}])"

    return f"""
        WITH RECURSIVE keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
        crc AS (
            SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda ch: ascii(ch)::BIGINT)),
                       lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS how FROM keyed),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE how WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc),
        numbered AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
                   NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS is_blank, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS is_cut FROM damaged),
        faulty AS (
            SELECT *, left(role, 1) AS letter, is_blank OR again AS must, CASE WHEN NOT is_blank AND NOT again AND is_cut THEN 3 ELSE 0 END AS t,
                   left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM numbered),
        costs(conv_id, i, v) AS (
            SELECT conv_id, max(i) + 1, [{{'c': 0::BIGINT, 'a': ''}}, {{'c': 6::BIGINT, 'a': 'II'}}, {{'c': 3::BIGINT, 'a': 'I'}}, {{'c': 0::BIGINT, 'a': ''}}] FROM faulty GROUP BY conv_id
            UNION ALL
            SELECT conv_id, i, [{", ".join(inserted(q) for q in range(4))}]
            FROM (SELECT f.conv_id, f.i, [{", ".join(row(q) for q in range(4))}] AS w FROM costs JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM costs.conv_id AND f.i = costs.i - 1)),
        best AS (SELECT conv_id, v[1].c AS cost, v[1].a AS audit FROM costs WHERE i = 1),
        edits AS (SELECT conv_id, p, substr(audit, p, 1) AS e, p - length(replace(left(audit, p), 'I', '')) AS inserts FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS p FROM best)),
        lines AS (
            SELECT edits.*, role, text, count(*) OVER w AS place, max(CASE WHEN e = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER w AS opened
            FROM edits LEFT JOIN faulty ON edits.conv_id IS NOT DISTINCT FROM faulty.conv_id AND e <> 'I' AND i = p - inserts
            WHERE e <> 'D' WINDOW w AS (PARTITION BY edits.conv_id ORDER BY p)),
        repaired AS (
            SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (place - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS whole
            FROM lines GROUP BY conv_id),
        counted AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank, count(*) FILTER (NOT is_blank AND again) AS duplicate,
                   count(*) FILTER (t > 0) AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
        SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
               CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
               sha256(coalesce(whole, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o
        LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN repaired ON repaired.conv_id IS NOT DISTINCT FROM o.conv_id"""
