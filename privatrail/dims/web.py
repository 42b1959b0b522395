"""Fixed values for requests, cookies, consent banners, grants and site purposes."""

from __future__ import annotations

# invented tracker and site lists; real ones are supplied by the user as tables
MODEL_TRACKERS = [
    "trackone.example", "adnet.example", "pixelworks.example", "statsbox.example", "idsync.example", "metrics.example",
    "reach.example", "audience.example", "beaconry.example", "tagroom.example", "profiler.example", "retarget.example",
]
MODEL_SITES = [
    ("site1.example", "ecommerce"), ("site2.example", "banking"), ("site3.example", "news"), ("site5.example", "recipe"),
    ("shop.co.uk", "ecommerce"), ("example.net", "news"), ("ththth.example.net", "recipe"), ("example.org", "education"),
]

# --- fixed values ---------------------------------------------------------------------------
# click identifiers that decorate links
DECORATION_KEYS = [
    "gclid", "fbclid", "msclkid", "dclid", "ttclid", "_ga", "mc_eid", "yclid", "gbraid", "wbraid", "igshid", "twclid",
]
PIXEL_KEYS = ["uid", "id", "cid", "email_hash"]
IDENTITY_LINK = r"(?iuUd)(?:match|sync|identify).{0,30}(?:hash|email|uid)|(?:email_hash|hashed_email)="
CANVAS_READ = ["canvas.toDataURL", "canvas.getImageData", "toDataURL"]
CANVAS_WRITE = ["canvas.fillText", "canvas.drawImage", "canvas.draw", "fillText"]
AUDIO_CONTEXT = ["AudioContext", "OfflineAudioContext", "audio.analysis"]
AUDIO_READ = ["AnalyserNode", "getFloatFrequencyData", "audio.analysis"]
ENUMERATION = [
    "navigator.plugins", "navigator.hardwareConcurrency", "navigator.deviceMemory", "WebGL.renderer", "font.enumeration",
]
MIN_COOKIE_DAYS = 30

# consent platforms: name, banner selectors
CMP_SELECTORS = [
    ("onetrust", ["#onetrust-banner-sdk"]),
    ("cookiebot", ["#CybotCookiebotDialog"]),
    ("quantcast", [".qc-cmp2-container"]),
    ("trustarc", ["#truste-consent-track", ".truste_overlay"]),
    ("didomi", ["#didomi-host"]),
    ("sourcepoint", ["[id^='sp_message_container']"]),
    ("usercentrics", ["#usercentrics-root"]),
    ("osano", [".osano-cm-window"]),
    ("klaro", [".klaro"]),
    ("complianz", [".cmplz-cookiebanner"]),
    ("cookieyes", [".cky-consent-container"]),
]
TCF_PURPOSES = [
    ("1", "necessary"), ("2", "advertising"), ("3", "profiling"), ("4", "advertising"), ("5", "profiling"),
    ("6", "profiling"), ("7", "analytics"), ("8", "analytics"), ("9", "analytics"), ("10", "analytics"),
]
CONSENT_PURPOSES = {
    "necessary": "necessary|essential|functional",
    "analytics": "analytics|statistics|measurement",
    "advertising": "advertis|marketing|personaliz|personalis",
    "profiling": "profil|cross.site",
}
COOKIE_WORDS = "cookies?|consent|privacy preferences"
ACCEPT_WORDS = "accept all|allow all|agree|alle akzeptieren|tout accepter|aceptar todo"
REJECT_WORDS = "reject|decline|deny|necessary only|refuser|ablehnen|rechazar"
SHAMING = (
    "no thanks.{0,30}(?:hate|boring|miss|worse)|don.t care about|prefer.{0,20}(?:bad|irrelevant)|reject.{0,20}(?:harm|lose)"
)
VENDORS_IN_TEXT = r"(\d+)\s+(?:vendors|partners)"

# purpose by keyword, in order
PURPOSE_KEYWORDS = {
    "image_tool": r"image.?compress|compress.?image|resize.?image|image.?resiz|png.?compress|jpeg.?compress",
    "file_converter": r"pdf.?convert|file.?convert|convert.?pdf|pdf.?compress|convert.?file",
    "government": r"visa.?portal|government|passport.?application|immigration|official.?tax",
    "banking": r"\bbank\b|banking|bank.?kyc|open.?bank.?account",
    "healthcare_provider": r"hospital|clinic|patient.?portal|healthcare",
    "free_download": r"free.?pdf.?download|download.?free.?pdf|free.?ebook|free.?download",
    "social": r"social.?photo|social.?network|share.?photos|social.?media",
    "recipe": r"\brecipe|cooking|cookbook|meal.?ideas",
    "wallpaper_utility": r"wallpaper",
    "backup": r"\bbackup\b|back.?up.?files",
    "screen_recorder": r"screen.?record|screen.?capture|screencast|\bobs\b",
    "password_manager": r"password.?manager|password.?vault|bitwarden|1password|keepass",
    "video_conference": r"video.?conferenc|video.?meeting|zoom|webex",
    "developer_tool": r"developer|\bide\b|code.?editor|github|gitlab",
    "saas_b2b": r"crm|project.?management|business.?software|team.?workspace|saas",
    "ecommerce": r"online.?shop|shopping|checkout|buy.?now|ecommerce",
    "news": r"news|journalism|headlines",
    "maps_navigation": r"navigation|directions|maps",
    "vpn": r"\bvpn\b|virtual.?private.?network",
    "accessibility_tool": r"screen.?reader|accessibility|voice.?control",
    "antivirus": r"antivirus|anti.?malware|security.?scanner",
}

# what a granted permission exposes
PERMISSION_CATEGORIES = {
    "camera": "camera",
    "microphone": "microphone",
    "location": "location_precise",
    "contacts": "contacts",
    "calendar": "calendar",
    "photos": "biometric_photo",
    "files": "files_broad",
    "full_disk": "files_broad",
    "accessibility": "accessibility",
    "screen": "screen",
    "input_monitoring": "accessibility",
    "automation": "automation",
    "notifications": "device_identifiers",
    "bluetooth": "device_identifiers",
    "startup": "startup",
    "background": "background_execution",
    "browser_history": "browser_history",
}
# extension permissions that reach beyond the extension itself
EXTENSION_ACCESSES = ["history", "tabs", "<all_urls>", "webRequest", "clipboardRead"]
# parts of the operating system
SYSTEM_PATHS = [
    "/system/", "/usr/libexec/", "/usr/sbin/", "/usr/bin/", "/sbin/", "/bin/", "/library/apple/", "c:/windows/",
    "c:/program files/windowsapps/microsoft.windows.",
]
SYSTEM_BUNDLE_PREFIX = "com.apple."
SYSTEM_IDENTITIES = [
    "microsoft.windows.", "microsoftwindows.", "windows.immersivecontrolpanel", "microsoft.aad.brokerplugin",
    "microsoft.lockapp", "microsoft.accountscontrol",
]
# bundles under the system prefix that a person launches
USER_FACING_BUNDLES = [
    "safari", "mail", "photos", "mobilesms", "facetime", "maps", "music", "tv", "podcasts", "notes", "ical", "addressbook",
    "reminders", "freeform", "preview", "quicktimeplayerx", "terminal", "ibooksx", "news", "shortcuts", "automator",
    "scripteditor2", "iwork.pages", "iwork.numbers", "iwork.keynote", "imovieapp", "dt.xcode",
]
# --- end of fixed values ----------------------------------------------------------------------
