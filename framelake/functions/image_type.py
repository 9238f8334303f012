"""What kind of image a file is, from its name, folder, size and camera."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name patterns, in the order in which they are tried.
WHATSAPP = r"(?i)^(IMG|VID|AUD|PTT)-[0-9]{8}-WA[0-9]+"
WHATSAPP_DESKTOP = r"(?i)^WhatsApp (Image|Video)\b"
TELEGRAM = r"(?i)^photo_[0-9]{4}-[0-9]{2}-[0-9]{2}_"
SCREEN = r"(?i)^(captura de (tela|ecr[ãa])|screenshot|screen shot|simulator screen shot)"
DOWNLOAD = r"(?i)^(image|imagem|unnamed|download|untitled|sem[-_ ]t[ií]tulo)[\s_-]*(\([0-9]+\))?$"
#: Screens in pixels, longer side first.
SCREENS = (
    (2556, 1179), (2796, 1290), (2532, 1170), (2778, 1284), (2436, 1125), (2688, 1242), (1792, 828), (2340, 1080),
    (2400, 1080), (2048, 1536), (2224, 1668), (2388, 1668), (2732, 2048), (2880, 1800), (3024, 1964), (3456, 2234),
    (2560, 1600), (3072, 1920), (1920, 1080), (2560, 1440), (3840, 2160), (1366, 768), (1440, 900),
)
LEAST_PIXELS = 480_000
#: Parts of folder names, without accents, and what the files in them are.
MESSENGER_FOLDERS = ("whatsapp", "telegram", "signal", "messenger")
SCREEN_FOLDERS = ("screenshots", "capturas de tela", "capturas")
DOWNLOAD_FOLDERS = ("downloads", "transferencias")
#: How each kind is called in a folder's name.
LABELS = {"photo": "Foto", "screen": "Captura de tela", "received": "Recebida em mensageiro", "downloaded": "Baixada da web"}


def image_type(name: Column, ext: Column, has_camera: Column, has_gps: Column, width: Column | None = None, height: Column | None = None, folder: Column | None = None) -> Column:
    """struct(kind, score, reason): GPS speaks for a photo; then names, folders, screens, downloads, and the lack of a camera.

    folder is the path without accents, in lower case (names.folded).
    """
    base = F.regexp_replace(name, r"\.[^.]*$", "")
    none = F.lit(None).cast("int")
    w, h = (none if width is None else width), (none if height is None else height)
    long_side, short_side = F.greatest(w, h), F.least(w, h)
    on_screen = F.coalesce(F.concat_ws("x", long_side, short_side).isin([f"{a}x{b}" for a, b in SCREENS]), F.lit(False))
    made = lambda kind, score, reason: F.struct(F.lit(kind).alias("kind"), F.lit(score).alias("score"), F.lit(reason).alias("reason"))
    within = lambda marks: F.lit(False) if folder is None else F.coalesce(folder.rlike("|".join(marks)), F.lit(False))
    bare = ~has_camera
    return (
        F.when(has_gps, made("photo", 0.95, "gps"))
        .when(base.rlike(WHATSAPP) | base.rlike(WHATSAPP_DESKTOP), made("received", 0.95, "messenger name"))
        .when(base.rlike(TELEGRAM), made("received", 0.90, "messenger name"))
        .when(base.rlike(SCREEN), made("screen", 0.95, "screenshot name"))
        .when(within(MESSENGER_FOLDERS), made("received", 0.85, "messenger folder"))
        .when(within(SCREEN_FOLDERS), made("screen", 0.85, "screenshot folder"))
        .when(on_screen & bare, made("screen", 0.85, "size of a screen"))
        .when(bare & within(DOWNLOAD_FOLDERS), made("downloaded", 0.80, "download folder"))
        .when(bare & base.rlike(DOWNLOAD), made("downloaded", 0.70, "download name"))
        .when(bare & (F.lower(ext) == "png"), made("screen", 0.55, "png without camera"))
        .when(bare & F.coalesce((w > 0) & (h > 0) & (w * h < LEAST_PIXELS), F.lit(False)), made("received", 0.55, "small without camera"))
        .when(bare, made("photo", 0.50, "nothing against it"))
        .otherwise(made("photo", 0.90, "camera"))
    )
