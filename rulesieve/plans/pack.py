"""A rule pack, decision table and guidance for the given tables."""

# Kinds: lines of documents are matched as dex_string, page URLs as zip_entry,
# URL paths as native_lib_name, order lines as manifest.
RULES = [
    dict(id="license-any", name="Any license mention", category="root", severity="low",
         behavior="log_only", evidence_location="dex_string", patterns=["License"],
         description="The word License anywhere.", guidance_key="license"),
    dict(id="license-apache", name="Apache license", category="root", severity="medium",
         behavior="soft_block", evidence_location="dex_string",
         patterns=["Apache License", "Version 2.0"], description="Apache license line.",
         guidance_key="license"),
    dict(id="license-mit", name="MIT license", category="play_integrity", severity="info",
         behavior="log_only", evidence_location="dex_string", patterns=["MIT License"],
         description="MIT license line.", guidance_key="license"),
    dict(id="license-gpl", name="GPL license", category="mtd_rasp", severity="high",
         behavior="hard_block", evidence_location="dex_string",
         patterns=["GNU General Public License", "version 3"], description="GPL license line.",
         guidance_key="copyleft"),
    dict(id="license-cc-nc", name="Non-commercial license", category="app_hardening",
         severity="critical", behavior="process_kill", evidence_location="dex_string",
         patterns=["CC BY-NC"], description="Non-commercial license line.",
         guidance_key="copyleft"),
    dict(id="rights-reserved", name="Rights reserved", category="anti_tamper", severity="medium",
         behavior="hard_block", evidence_location="dex_string",
         patterns=["rights reserved", "All rights reserved", "Copyright"],
         description="A reservation of rights.", guidance_key="missing-key"),
    dict(id="secret-token", name="Token in text", category="anti_hooking", severity="critical",
         behavior="process_kill", evidence_location="dex_string",
         patterns=["token = \"", "api_key", "AKIA"], description="A credential in the text.",
         guidance_key="secret"),
    dict(id="release-note", name="Release wording", category="anti_hooking", severity="low",
         evidence_location="dex_string", patterns=["MIT License", "Released under"],
         description="Shares a pattern with another rule; behavior not classified."),
    dict(id="contact-phone", name="Phone number", category="anti_emulator", severity="low",
         behavior="soft_block", evidence_location="dex_string", patterns=["+1 ("],
         description="A phone number.", guidance_key="contact"),
    dict(id="contact-mail-host", name="Mail host", category="anti_emulator", severity="medium",
         behavior="log_only", evidence_location="dex_string", patterns=["@mail"],
         description="A mail host.", guidance_key="contact"),
    dict(id="never-present", name="Never present", category="clone_repackage", severity="high",
         behavior="hard_block", evidence_location="dex_string",
         patterns=["zzz-not-in-any-text"], description="Never fires."),
    dict(id="mail-address", name="Mail address", category="app_defense", severity="high",
         behavior="soft_block", evidence_location="dex_string", is_regex=True,
         patterns=["[A-Za-z0-9._]+@[A-Za-z0-9.]+\\.[a-z]{2,}"],
         description="A complete mail address.", guidance_key="contact"),
    dict(id="long-number", name="Long number", category="app_defense", severity="medium",
         behavior="hard_block", evidence_location="dex_string", is_regex=True,
         patterns=["[0-9]{16}", "([0-9]{1,3}\\.){3}[0-9]{1,3}"],
         description="A card-like number or a network address."),
    dict(id="url-tracking", name="Tracking parameter", category="app_defense", severity="low",
         behavior="log_only", evidence_location="zip_entry", patterns=["utm_source=", "ref="],
         description="A tracking parameter in a URL.", guidance_key="tracking"),
    dict(id="url-unwanted-host", name="Unwanted host", category="clone_repackage",
         severity="critical", behavior="process_kill", evidence_location="zip_entry",
         patterns=["spam-farm", "cheap-pills"], description="A host nobody wants.",
         guidance_key="tracking"),
    dict(id="url-encrypted", name="Encrypted URL", category="play_integrity", severity="info",
         behavior="log_only", evidence_location="zip_entry", patterns=["https://", "://www."],
         description="A URL over an encrypted connection."),
    dict(id="lib-paged", name="Paged path", category="mtd_rasp", severity="medium",
         behavior="soft_block", evidence_location="native_lib_name",
         patterns=["page=", ".html", "#top"], description="A paged or static path."),
    dict(id="manifest-full-returned", name="Full pack returned", category="anti_tamper",
         severity="high", behavior="hard_block", evidence_location="manifest",
         patterns=["qty=50 flag=R", "qty=49 flag=R"], description="A large returned line."),
    dict(id="manifest-next-line", name="Return before another line", category="app_hardening",
         severity="medium", behavior="soft_block", evidence_location="manifest",
         patterns=["flag=R item part=1"], description="Spans two neighbouring lines."),
]

# Attributes of a profile: one per event type.
FIELDS = ["click", "error", "purchase", "signup", "view"]

# (rule, row, fields, verdict, detail); rows are tried in order.
CONDITIONS = [
    ("license-any", 1, {"view": False}, "not_triggered", "never looks"),
    ("license-any", 2, {"view": True, "click": True}, "not_triggered", "looks and clicks"),
    ("license-any", 3, {"view": True, "click": False}, "triggered", "looks without a click"),
    ("license-apache", 1, {"purchase": False}, "not_triggered", "buys little"),
    ("license-apache", 2, {"purchase": True}, "triggered", "buys much"),
    ("license-gpl", 1, {"click": True}, "triggered", "clicks much"),
    ("license-gpl", 2, {"view": True}, "triggered", "views much"),
    ("license-gpl", 3, {"click": False, "view": False}, "not_triggered", "neither"),
    ("license-cc-nc", 1, {"error": False}, "not_triggered", "few errors"),
    ("license-cc-nc", 2, {"error": True, "signup": True}, "not_triggered", "masked by sign-up"),
    ("license-cc-nc", 3, {"error": True, "signup": False}, "triggered", "errors unmasked"),
    ("rights-reserved", 1, {}, "not_triggered", "always passes"),
    ("secret-token", 1, {"signup": True}, "triggered", "signed up"),
    ("secret-token", 2, {"error": True}, "triggered", "many errors"),
    ("secret-token", 3, {"signup": False}, "not_triggered", "not signed up"),
    ("contact-phone", 1, {"error": True}, "triggered", "many errors"),
    ("long-number", 1, {"purchase": True, "view": True}, "triggered", "views and buys"),
    ("long-number", 2, {"purchase": False}, "not_triggered", "buys little"),
    ("no-such-rule", 1, {}, "triggered", "a condition without a rule"),
]

GUIDANCE = [
    ("license", "Keep the notice."),
    ("copyleft", "Ask before mixing."),
    ("secret", "Revoke it."),
    ("contact", "Mask it."),
    ("tracking", "Strip the parameter."),
]

# License lines, in the order they are tested.
LICENSE_MARKERS = [
    ("GNU General Public License", "gpl"),
    ("Apache License", "apache"),
    ("MIT License", "mit"),
    ("CC BY-NC", "cc-by-nc"),
    ("License", "other license"),
    ("rights reserved", "reserved"),
]
