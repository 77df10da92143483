import hashlib
import random
import re
import time

from lexmill.llm import pii, secrets


def luhn(d):
    t = 0
    for i, c in enumerate(d[::-1]):
        v = int(c) * (2 if i % 2 else 1)
        t += v if v < 10 else v - 9
    return t % 10 == 0


def brute_pii(text):
    out = []
    for kind, p, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub(r"[^0-9]", "", m[0])) <= 19 and luhn(re.sub(r"[^0-9]", "", m[0]))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.findall("[0-9]", m[0])) <= 15),
    ):
        out += [(kind, *m.span()) for m in re.finditer(p, text) if ok(m)]
    return out


def test_pii_base_is_the_leftmost_matches():
    rng = random.Random(5)
    parts = ["a", "1", "12", "255", "256", "4111 1111 1111 1111", ".", "@", "-", " ", "+", "(", ")", "é", "b.c", "x@y.z", "::", "%", "1.2.3.4", "+1 (437) 555-0689", "\n", "²", "٣"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert pii.spans(text)[0] == brute_pii(text), text


def test_pii_added_spans():
    text = "db postgres://bob:hunter2@db.local:5432/x IBAN: GB82 WEST 1234 5698 7654 32 and SSN 078-05-1120 Account no. 12345678"
    kinds = {k: text[s:e] for k, s, e in pii.spans(text)[1]}
    assert kinds["url"] == "postgres://bob:hunter2@db.local:5432"
    assert kinds["iban"] == "GB82 WEST 1234 5698 7654 32"
    assert kinds["ssn"] == "078-05-1120" and kinds["account"] == "12345678"
    for scheme in ("a" * 5000, "x.y+z-1" * 300):
        assert pii.spans(f"7-.{scheme}://u:p@h.example")[1] == [("email", len(scheme) + 8, len(scheme) + 19), ("url", 3, len(scheme) + 19)]
    assert pii.spans("1.5://u:p@h")[1] == []
    assert pii.spans("on account of the rain, ibanez; ssn unknown")[1] == []


def brute_secrets(text):
    out = []
    for kind, p, least in (
        ("assign", r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12),
        ("access", r"AKIA[A-Z0-9]+", 18),
        ("hex", r"[0-9a-f]+", 16),
    ):
        out += [(kind, *m.span()) for m in re.finditer(p, text) if len(m[2] if kind == "assign" else m[0]) >= least]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secret_base_is_the_leftmost_matches():
    rng = random.Random(6)
    parts = ["token", "Secret", "API_KEY", "apikey", "=", " = ", ": ", '"', "'", "0123456789abcdef", "AKIA", "ABCDEFGHIJKLMN", "xyz", " ", "\n", "ſecret", "é", "deadbeef", "/+", "12"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        base, every = secrets.spans(text)
        assert base == brute_secrets(text), text
        assert set(base) <= set(every)


def test_secrets_by_name_and_reference():
    text = 'K = "Zq8!vT2#pL9@wX4z"\ncolor = "Zq8!vT2#pL9@wX4y"\nalias = K\nclient_secret = alias\n"dbPassword": "s3cr3t!" + "Pa55#word",\npwd: example-value-1234\n'
    found = [text[s:e] for k, s, e in secrets.spans(text)[1] if k == "literal"]
    assert found == ["Zq8!vT2#pL9@wX4z", 's3cr3t!" + "Pa55#word']


def test_scans_and_defined_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a@b.co " * 3000 + "token = 0123456789abcdef", "x"), (3, "a@b.co " * 3000 + "token = 0123456789abcdef", "x"), (None, "é +1 (437) 555-0689", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = pii.scan(docs).toPandas()
    assert out.columns.tolist() == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert len(out) == 5 and out["n_email"].sum() == 6000 and out["n_phone"].sum() == 1
    empty = hashlib.sha256(b"").hexdigest()
    assert (out["base_sha256"] == empty).sum() == 2
    assert out[out.doc_id.isna()]["spans"].item() == "phone:2:19"
    sec = secrets.scan(docs).toPandas()
    assert sec["n_assign"].sum() == 2 and sec["n_hex"].sum() == 2
    assert pii.scan(docs.limit(0)).count() == 0 and secrets.scan(docs.limit(0)).count() == 0
    clean = pii.redact(docs).toPandas()
    assert clean["text"].iloc[4] == "é [PHONE]" and clean["text"].iloc[1] == "" and clean["text"].isna().sum() == 1


def test_pii_cues_in_any_case():
    for text in ("Social Security Number: 078-05-1120", "SOCIAL security no. 078-05-1120", "İ Social Security 078-05-1120", "Ssn: 078-05-1120"):
        assert [(k, text[s:e]) for k, s, e in pii.spans(text)[1]] == [("ssn", "078-05-1120")], text
    for text in ("IBAN Number: GB82 WEST 1234 5698 7654 32", "IBAN No. GB82 WEST 1234 5698 7654 32", "iBan nr GB82 WEST 1234 5698 7654 32"):
        assert [(k, text[s:e]) for k, s, e in pii.spans(text)[1]] == [("iban", "GB82 WEST 1234 5698 7654 32")], text
    assert pii.spans("IBAN Number: gb82 west 1234 5698 7654 32")[1] == []


def literals(text):
    return [text[s:e] for k, s, e in secrets.spans(text)[1] if k == "literal"]


def test_secrets_typed_assignments():
    for text in (
        'db_password: str = "Zx9kQ2mmLp77"', "const apiKey: string = 'Zx9kQ2mmLp77'", 'const apiKey:string="Zx9kQ2mmLp77"', 'token: Optional[str] = "Zx9kQ2mmLp77"',
        'db_password: str | None = "Zx9kQ2mmLp77"', 'const API_KEY: &\'static str = "Zx9kQ2mmLp77";', 'val apiKey: String? = "Zx9kQ2mmLp77"', 'K = "Zx9kQ2mmLp77"\ndb_password: str = K',
        'db_password: dict[str, list[str]] = "Zx9kQ2mmLp77"', 'db_password: app.Text = "Zx9kQ2mmLp77"', 'K: str = "Zx9kQ2mmLp77"\ndb_password = K',
    ):
        assert literals(text) == ["Zx9kQ2mmLp77"], text


def test_a_type_is_no_constant_and_no_value_is_a_type():
    assert literals('color: str = "Zx9kQ2mmLp77"\ntoken: str') == []
    assert literals('color: Hue = "Zx9kQ2mmLp77"\ntoken: Hue\n') == []
    assert literals('color: str = "Zx9kQ2mmLp77"\ntoken = str(x)') == []
    # As before: a label before an assignment, a constant after one, values that hold an equals sign.
    assert literals('config: db_pwd = "Zx9kQ2mmLp77"') == ["Zx9kQ2mmLp77"]
    assert literals('here: K = "Zx9kQ2mmLp77"\nclient_pwd = K') == ["Zx9kQ2mmLp77"]
    assert literals("db_pwd: Zx9kQ2mm=Lp77\n") == ["Zx9kQ2mm=Lp77"]
    assert literals("db_pwd: QWxhZGRpbjpvcGVu1=\n") == ["QWxhZGRpbjpvcGVu1="]


SECRET = "Zx9kQ2mmLp77"


def test_secrets_lexing():
    for text in (
        f'K = "{SECRET}"; if K == x: y\nclient_secret = K', f'client_pwd: str = """{SECRET}"""', f"client_pwd = '''{SECRET}'''", f"<cfg><db.pwd>{SECRET}</db.pwd></cfg>",
        f'<add key="DbPwd" value="{SECRET}"/>', f'// client_pwd = "{SECRET}"', f'K = "{SECRET}"\ndef f():\n    client_pwd = K\n', f'client_pwd = r"{SECRET}"', f"it's client_pwd = '{SECRET}'",
        f'config["pwd"] = "{SECRET}"', f"x?user=a&pwd={SECRET}&b=c", f"config:client_pwd={SECRET}", f'"client pwd": "{SECRET}"', f'pwd => "{SECRET}"', f"pwd += '{SECRET}'", f'pwd ?= "{SECRET}"', f'pwd := "{SECRET}"',
        f'client_pwd = ("{SECRET}"\n)', f'{"x" * 500}_pwd = "{SECRET}"', f'client_pwd: {"List[" + "a" * 300 + "]"} = "{SECRET}"',
    ):
        assert literals(text) == [SECRET], text
    for text in (
        f'# K = "{SECRET}"\nclient_pwd = K', f'/* K = "{SECRET}" */ client_pwd = K', f'def f():\n    K = "{SECRET}"\n    x = 1\nclient_pwd = K', f'pwd != "{SECRET}"', f'pwd == "{SECRET}"', f'pwd::"{SECRET}"',
        f'x = "pwd = {SECRET}"', f"<db.pwd>{SECRET}</db.user>",
    ):
        assert literals(text) == [], text


def test_secret_lexing_against_generated_programs():
    """Programs of statements whose pairs are known when they are written; a second reading by plain rules."""
    rng = random.Random(8)
    for _ in range(400):
        text, want, known = "", [], {}
        for i in range(rng.randrange(1, 9)):
            value = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(16)) + "a9"
            name, sensitive = rng.choice([("pwd", True), ("db.passphrase", True), ("colour", False), ("title", False)])
            quote = rng.choice(['"', "'"])
            shape = rng.randrange(7)
            if shape == 0:
                known[f"K{i}"] = (len(text) + len(f"K{i} = ") + 1, value)
                text += f"K{i} = {quote}{value}{quote}\n"
                continue
            if shape == 1 and known:
                key = rng.choice(sorted(known))
                text += f"{name} = {key}\n"
                at, value = known[key]
            elif shape == 2:
                at = len(text) + len(name) + 2
                text += f"{name}: {value}\n"
            elif shape == 3:
                at = len(text) + len(name) + 9
                text += f"{name}: str = {quote}{value}{quote}\n"
            elif shape == 4:
                at = len(text) + 2 * len(name) + 7
                text += f"<x><{name}> {value} </{name}></x>\n"
                at = text.rindex(value)
            elif shape == 5:
                text += f"if {name} == {quote}{value}{quote}: pass\n"
                continue
            else:
                at = len(text) + len(name) + 5
                text += f'"{name}": {quote}{value}{quote},\n'
                at = text.rindex(value)
            if sensitive:
                want.append(("literal", at, at + len(value)))
        assert sorted(set(want)) == [s for s in secrets.spans(text)[1] if s[0] == "literal"], text


def test_fences_backticks_and_inch_marks():
    held = f'db_pwd = "{SECRET}"'
    for text in (
        f"Text:\n```python\n{held}\n```\nmore", f"a ` stray\n\n{held}\n\nand ` another", f'5" pipe, {held}', f"db_pwd = `{SECRET}`", f"use `x` and {held}", f"```\n``` {held}", f"`````{held}",
        f"print(`{{a}}\n{{b}}`)\n{held}",
    ):
        assert literals(text) == [SECRET], text
    assert literals(f"`{held}`") == [] and literals(f"x = `\n{held}\n`") == []


def test_scans_take_time_in_proportion():
    for unit in ("a=", "token=", '"\\', "/*", "a:b[", "<a>", "`", "a`", "=`", "```", "=` \n", '5"', 'a="', "&a", "\n def f: ", "a@b.c ", "1.1", "+1 (", "account", "a://b:c@d "):
        for scan in (secrets.spans, pii.spans):
            seconds = []
            for size in (100_000, 800_000):
                began = time.process_time()
                scan(unit * (size // len(unit)))
                seconds.append(time.process_time() - began)
            assert seconds[1] < 30 * seconds[0] + 1, (unit, scan.__module__, seconds)
