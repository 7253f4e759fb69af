"""A plain line-by-line model of the three detectors, written from their description, to hold the window forms against."""

import re


def lines(diff):
    if not diff:
        return []
    return re.split(r"\r?\n", re.sub(r"\r?\n\Z", "", diff))


def start(text, ends):
    m = re.fullmatch(r"\+?[0-9]+", text)
    return int(text) if m and int(text) <= 4294967295 else 1


def path_of(line, before):
    parts = line.split(" b/")
    return parts[1].strip() if len(parts) > 1 else before


def commented(diff):
    found, file, hunk = [], "", {"file": "", "line": 0, "gone": [], "new": []}

    def flush():
        gone, new = hunk["gone"], hunk["new"]
        if hunk["file"] and len(gone) >= 3 and new:
            hits = sum(any(a in (f"// {g}", f"//{g}") or a.lstrip("/").lstrip("*").strip() == g for a in new) for g in gone)
            if hits * 10 >= len(gone) * 6:
                found.append((hunk["file"], hunk["line"], len(gone)))
        hunk["gone"], hunk["new"] = [], []

    for line in lines(diff):
        if line.startswith("diff --git"):
            flush()
            file = hunk["file"] = path_of(line, file)
        elif line.startswith("@@"):
            flush()
            hunk["file"] = file
            if "+" in line:
                hunk["line"] = start(line.split("+")[1].split(",")[0].strip(), ",")
        elif line.startswith("-") and not line.startswith("---"):
            hunk["gone"] += [line[1:].strip()] if line[1:].strip() else []
        elif line.startswith("+") and not line.startswith("+++"):
            hunk["new"] += [line[1:].strip()] if line[1:].strip() else []
    flush()
    return found


def name_of(line):
    t = line.strip()
    for p in (r"(?:const|let|var) ([\w$]+)", r"def (\w+)"):
        if m := re.match(p, t):
            return m[1]
    head, found, _ = t.partition(" := ")
    m = re.search(r"(\w+)$", head)
    return m[1] if found and m else None


def removed_used(diff):
    found, file, own, first = [], "", [], 1

    def flush():
        if file:
            used = {w for gone, t in own if not gone for w in re.findall(r"[\w$]+", t)}
            found.extend((file, first + i, name_of(t)) for i, (gone, t) in enumerate(own) if gone and name_of(t) in used)

    for line in lines(diff):
        if line.startswith("diff --git"):
            flush()
            own, file = [], path_of(line, file)
        elif line.startswith("@@"):
            if "+" in line and not own:
                first = start(line.split("+")[1].split(",")[0].strip(), ",")
        elif line.startswith("-") and not line.startswith("---"):
            own.append((True, line[1:]))
        elif line.startswith("+") and not line.startswith("+++"):
            own.append((False, line[1:]))
        else:
            own.append((False, line))
    flush()
    return found


def rule_hits(diff, rules):
    found, file, n = [], "", 1
    for line in lines(diff):
        if line.startswith("diff --git "):
            file = path_of(line, file)
        elif line.startswith("@@ ") and "+" in line:
            n = start(re.split("[, ]", line.split("+")[1])[0], "")
        elif line.startswith("+") and not line.startswith("+++"):
            found += [(file, n, i) for i, (p, globs) in enumerate(rules) if re.search(p, line[1:]) and (not globs or any(fits(file, g) for g in globs))]
            n += 1
        elif line.startswith(" "):
            n += 1
    return found


def fits(path, g):
    return g == "*" or (path.endswith(g[1:]) if g.startswith("*.") else path == g or path.endswith(f"/{g}"))


def chunks(diff, most):
    out, now, n = [], "", 0
    for line in lines(diff):
        if (line.startswith("diff --git") or n >= most) and now:
            out.append(now)
            now, n = "", 0
        now, n = now + line + "\n", n + 1
    return out + [now] if now else out
