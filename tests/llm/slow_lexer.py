"""A slow, character-wise reading of the lexer's grammar, to hold it against."""

from graphloom.llm import secrets as S

WORD = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
STOP = set("\"'`,;(){}[]<>")
BLANK = " \t"


def names(text):
    """(start, end) of all names, and the places that names take up."""
    out, i = [], 0
    while i < len(text):
        if text[i] in WORD and not text[i].isdigit():
            j = i
            while j < len(text) and (text[j] in WORD or text[j] in ".-" and j + 1 < len(text) and text[j + 1] in WORD):
                j += 1
            out.append((i, j))
            i = j
        else:
            i += 1
    return out


def signs(text):
    taken = {k for a, b in names(text) for k in range(a, b)}
    out, i = [], 0
    while i < len(text):
        c, before, after = text[i], text[i - 1 : i] if i else "", text[i + 1 : i + 2]
        n = 0
        if i not in taken:
            if c + after in ("=>", ":="):
                n = 2
            elif c == "=" and before not in tuple("=!<>:") and after not in tuple("=>~"):
                n = 1
            elif c == ":" and before != ":" and after not in tuple(":/="):
                n = 1
            elif c == ">" and before in tuple(WORD) and after and not after.isspace() and after not in "<>=":
                n = 1
        if n:
            out.append((i, i + n))
        i += max(n, 1)
    return out


def string(text, i):
    k = i
    while k < len(text) and k - i < 2 and text[k] in "rbufRBUF":
        k += 1
    slashes = 0
    while k < len(text) and text[k] == "\\":
        slashes, k = slashes + 1, k + 1
    quote = text[k : k + 3] if text[k : k + 3] in ('"""', "'''") else text[k : k + 1]
    if quote not in ('"""', "'''", '"', "'", "`"):
        return None
    a = j = k + len(quote)
    many = len(quote) == 3 or quote == "`"
    while True:
        if slashes:
            if j >= len(text) or text[j] == "\n":
                return None
            if text.startswith("\\" * slashes + quote, j):
                break
            j += 1
            continue
        if j >= len(text) or text[j] == "\n" and not many:
            return None
        if text.startswith(quote, j):
            break
        if text[j] == "\\":
            if j + 1 >= len(text):
                return None
            j += 1
        j += 1
    said, out, k = text[a:j], "", 0
    while k < len(said):
        if said[k] == "\\" and k + 1 < len(said):
            e = said[k + 1]
            n = {"u": 4, "x": 2}.get(e, 0)
            digits = said[k + 2 : k + 2 + n]
            if n and len(digits) == n and all(c in "0123456789abcdefABCDEF" for c in digits):
                out += chr(int(digits, 16))
                k += 2 + n
            else:
                out += {"n": "\n", "t": "\t", "r": "\r", "\n": ""}.get(e, e)
                k += 2
        else:
            out += said[k]
            k += 1
    if many:
        out = "".join(x.strip() for x in out.splitlines())
    return (a, j, out), j + slashes + len(quote)


def block(text, i, key):
    while text[i : i + 1] in tuple(BLANK):
        i += 1
    if text[i : i + 1] not in tuple("|>"):
        return None
    head, newline, rest = text[i + 1 :].partition("\n")
    marks = head.split("#")[0].rstrip(BLANK)
    if not newline or len(marks) > 2 or any(c not in "+-0123456789" for c in marks):
        return None
    line = text[text.rfind("\n", 0, key) + 1 :]
    indent = len(line) - len(line.lstrip(BLANK))
    at, held = i + 1 + len(head) + 1, []
    for x in rest.split("\n"):
        body = x.lstrip(BLANK)
        if body and len(x) - len(body) <= indent:
            break
        if body:
            held.append((at + len(x) - len(body), at + len(x), body.rstrip()))
        at += len(x) + 1
    return (held[0][0], held[-1][1], "".join(x[2] for x in held)) if held else None


def skip(text, i):
    while i < len(text) and text[i] in BLANK:
        i += 1
    return i


def ident(word):
    return bool(word) and all(p and p[0] in WORD and not p[0].isdigit() and set(p) <= WORD for p in word.split("."))


def assignments(text, known):
    ends = {}
    for a, b in names(text):
        ends[b] = (a, b)
    order = sorted(ends)
    outer = inner = -1
    typed, late = None, None
    used = -1
    for at, end in signs(text):
        sign = text[at:end]
        before = [e for e in order if used <= ends[e][0] and e <= at]
        used = end
        name = ends[before[-1]] if before else None
        if sign == "=" and typed and all(c in WORD or c in " \t.,|[]?&<>*" for c in text[typed[1] : at]):
            name, late = typed[0], None
        else:
            if name is None or at < inner:
                continue
            gap = text[name[1] : at].lstrip("\\")
            gap = gap[1:] if gap[:1] in tuple("\"'`") else gap
            gap = gap[1:] if gap[:1] == "]" else gap
            gap = gap.lstrip(BLANK)
            if len(gap) > 2 or any(c not in "+?|&" for c in gap) or sign == ">" and text[max(name[0] - 1, 0) : name[0]] != "<":
                continue
        if late:
            yield late
            late = None
        typed = (name, end) if sign == ":" else None
        i = skip(text, end)
        if sign == ":" and (b := block(text, i, name[0])):
            yield text[slice(*name)], [b], []
            continue
        literals, whole, some = [], [], False
        while True:
            s = string(text, i)
            if s:
                literals.append(s[0])
                i, some = s[1], True
            else:
                j = i
                stops = STOP | set("=&?") if i < outer else STOP
                while j < len(text) and not text[j].isspace() and text[j] not in stops:
                    j += 1
                if j == i:
                    break
                token, some = text[i:j], True
                if "+" in token:
                    after = skip(text, i + token.rfind("+") + 1)
                    k = after
                    while k < len(text) and (text[k] in WORD or text[k] == "." and text[k + 1 : k + 2] in tuple(WORD) and not text[k + 1].isdigit()):
                        k += 1
                    if string(text, after) or after > j and text[after:k] in known and not text[after].isdigit():
                        j = i + token.rfind("+")
                if i < outer:
                    inner = j
                else:
                    outer = j
                word = text[i:j].rstrip(".:!?")
                parts = word.split("+")
                refs = [x for x in parts if ident(x) and x in known]
                fresh = not literals and word and len(refs) < len(parts)
                for x in refs:
                    literals += known[x]
                if fresh:
                    (whole if refs else literals).append((i, i + len(word), word))
                i = j
            k = skip(text, i)
            if text[k : k + 1] == "+":
                k = skip(text, k + 1)
                i = skip(text, k + 1) if text[k : k + 1] == "\n" else k
            elif k > i and text[k : k + 1] in ('"', "'"):
                i = k
            else:
                break
        if some:
            pair = (text[slice(*name)], literals, whole)
            if typed:
                late = pair
            else:
                yield pair
    if late:
        yield late


def lexed(text, threshold=0.6):
    known, found = {}, set()
    for name, literals, whole in assignments(text, known):
        literals = list(dict.fromkeys(literals))
        if literals or whole:
            known[name] = literals + whole
            for some in (literals, whole):
                score = S.name_score(name) * S.literal_score("".join(x[2] for x in some))
                if some and score >= threshold and score > 0 and not all(S._DUMMY.match(x[2]) for x in some):
                    found.update((a, b) for a, b, _ in some if b > a)
    return sorted(found)
