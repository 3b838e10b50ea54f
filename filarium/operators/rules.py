"""Result constants of the file classifier."""

# ---- Fixed values: one entry per rule ---------------------------------------
# key, category, subcategory, confidence, destination, suggested action,
# recommended action, reason, safe, explanation, tags.
# In explanations: %1$s extension, %2$s file name, %3$s whole megabytes,
# %4$s keyword, %5$s extension or lower-case name, %6$s extension or
# "no extension". In tags: {ext} extension without dot, {kw} keyword.
_MEDIA_ACTION = "Review whether this asset is still needed."
_MEDIA_REASON = "Verify whether this media is still needed."
_INSPECT = "Inspect manually — no category pattern matched."
_LOCK_ACTION = "Safe to delete once the owning application is closed."
_LOCK_REASON = "Lock files have no data value; they are recreated automatically."
_WEB_ACTION = "Keep with the rest of the project; do not move individually."
_WEB_REASON = ("Part of a project's source tree — moving it individually would "
               "break the build.")
_DESIGN_ACTION = "Keep and back up — design source files are usually not reproducible."
_DESIGN_REASON = "Design source files should be retained and backed up."
_PHOTO_ACTION = "Review for duplicates before removing."
_PHOTO_REASON = "Review whether duplicates exist before removing."

RULES = [
    ("duplicate", "Duplicate Candidates", None, 90, None,
     "Review both copies and keep the one in the more appropriate location.",
     "review", "Confirm which copy to keep before removing either.", False,
     "This file's contents match another file already indexed in this scan — a byte-for-byte duplicate.",
     ["duplicate", "review"]),
    ("lock_indesign", "Lock Files", "Adobe InDesign lock", 96, None, _LOCK_ACTION,
     "delete", _LOCK_REASON, True,
     "Adobe InDesign lock file (.idlk) — created automatically while InDesign is open.",
     ["lock-file", "temp"]),
    ("lock_application", "Lock Files", "Application lock", 96, None, _LOCK_ACTION,
     "delete", _LOCK_REASON, True,
     "Lock file (%5$s) — created by an application to claim exclusive access to a resource.",
     ["lock-file", "temp"]),
    ("locked", "Lock Files", None, 82, None,
     "Verify no application is currently using this file before deleting.",
     "review", "Verify no application is currently using this file.", False,
     "Lock file (.locked) — indicates an application has claimed ownership of a resource. Review before removing.",
     ["lock-file", "temp"]),
    ("screenshot", "Screenshots", None, 92, "Pictures/Screenshots",
     "Review periodically — screenshots accumulate quickly and are rarely needed long-term.",
     "review", "Screenshots are often transient; confirm before bulk deleting.", False,
     "Filename matches common screenshot/screen-recording naming conventions.",
     ["screenshot", "image"]),
    ("zero_byte", "Temporary Files", None, 95, None,
     "Safe to delete — the file has no content to lose.",
     "delete", "File contains no data.", True,
     "Empty file with 0 bytes of content — likely a leftover placeholder, failed download, or incomplete write.",
     ["empty", "zero-byte", "junk"]),
    ("empty_folder", "Temporary Files", None, 95, None,
     "Safe to delete — the folder holds nothing.",
     "delete", "Folder contains no files or subfolders.", True,
     "Empty folder with no children — leftover from a moved or deleted collection.",
     ["empty-folder", "junk"]),
    ("installer", "Installers", None, 93, None,
     "Delete once you've confirmed the software installed correctly — it can be re-downloaded if needed.",
     "delete", "Installer packages can be re-downloaded from the vendor if needed.", False,
     "Installation package (%1$s, %3$s MB) — once software is installed this file is no longer needed.",
     ["installer", "software", "package", "{ext}"]),
    ("archive", "Archives", None, 90, None,
     "Inspect the archive contents before deleting.",
     "review", "Archives may contain important files. Check contents before deleting.", False,
     "Compressed archive (%1$s) — verify the contents are either backed up or no longer needed before removing.",
     ["archive", "compressed", "{ext}"]),
    ("temporary", "Temporary Files", None, 85, None,
     "Safe to remove after confirming no active process needs it.",
     "delete", "Temporary files are usually safe to remove.", True,
     "Temporary or partial file (%1$s) — typically safe to remove after verifying no application depends on it.",
     ["temp", "junk", "{ext}"]),
    ("log", "Temporary Files", None, 78, None,
     "Review for anything useful, then delete.",
     "review", "Logs may contain useful diagnostic information.", False,
     "Log file — useful for debugging but accumulates over time. Safe to remove once reviewed.",
     ["log", "temp"]),
    ("web_folder", "Web Development", None, 92, None, _WEB_ACTION, "keep", _WEB_REASON, True,
     "Recognised web project file (%2$s) inside a \"%4$s\" folder — part of a software/web project.",
     ["web", "development", "project"]),
    ("web", "Web Development", None, 84, None, _WEB_ACTION, "keep", _WEB_REASON, True,
     "Recognised web project file (%2$s) — part of a software/web project.",
     ["web", "development", "project"]),
    ("web_zip", "Web Development", None, 70, None,
     "Verify it's an outdated project backup before deleting.",
     "review", "Could be a valuable project backup.", False,
     "This ZIP archive sits beside package.json/source folders — likely a web project export or backup.",
     ["web", "archive", "project"]),
    ("branding", "Branding", None, 90, "Design/Branding",
     "Keep — branding assets are reused across many projects.",
     "keep", "Brand assets should be preserved as a single source of truth.", True,
     "Vector asset (%1$s) with branding keyword \"%4$s\" — part of a brand identity or logo system.",
     ["branding", "logo", "vector"]),
    ("design_folder", "Design", None, 95, "Design", _DESIGN_ACTION, "keep", _DESIGN_REASON, True,
     "Design file (%1$s) in a \"%4$s\" folder — belongs to a creative or design workflow.",
     ["design", "creative", "{ext}"]),
    ("design", "Design", None, 90, "Design", _DESIGN_ACTION, "keep", _DESIGN_REASON, True,
     "Design file (%1$s) — belongs to a creative or design workflow.",
     ["design", "creative", "{ext}"]),
    ("design_document", "Design", None, 75, "Design",
     "Keep alongside the related design project.",
     "keep", "Creative project documents should be archived with the project.", True,
     "Document in a \"%4$s\" folder — likely a design brief, spec, or creative reference.",
     ["design", "document"]),
    ("photo_raw", "Photography", "RAW original", 95, "Pictures",
     "Back up before considering deletion — this is an unrepeatable original.",
     "keep", "RAW files are originals — back up before any deletion.", False,
     "RAW camera file (%1$s) — original image data; cannot be regenerated from a compressed copy.",
     ["image", "photography", "raw", "{ext}"]),
    ("photo_folder", "Photography", "Photo", 88, "Pictures", _PHOTO_ACTION, "review",
     _PHOTO_REASON, False,
     "Image file (%1$s) in a \"%4$s\" folder.",
     ["image", "photography", "photo", "{ext}"]),
    ("photo", "Photography", "Photo", 88, "Pictures", _PHOTO_ACTION, "review",
     _PHOTO_REASON, False,
     "Image file (%1$s).",
     ["image", "photography", "photo", "{ext}"]),
    ("video", "Video", None, 90, "Movies",
     "Video files can be large; verify duplicates or unneeded exports before deleting.",
     "review", "Video files can be large; verify duplicates before deleting.", False,
     "Video file (%1$s, %3$s MB) — likely a recording, export, or downloaded clip.",
     ["video", "{ext}"]),
    ("audio", "Audio", None, 88, "Music",
     "Keep if original; confirm it's backed up elsewhere.",
     "keep", "Review whether this audio is backed up elsewhere.", False,
     "Audio file (%1$s) — music track, recording, or sound effect.",
     ["audio", "{ext}"]),
    ("code", "Software", None, 85, None,
     "Keep under version control; do not move individually.",
     "keep", "Source files should be kept under version control.", True,
     "Source code file (%1$s) — likely part of a development project.",
     ["code", "software", "source", "{ext}"]),
    ("video_hint", "Video", None, 58, "Movies", _MEDIA_ACTION, "review", _MEDIA_REASON, False,
     "File in a \"%4$s\" folder — probable video asset.", ["video"]),
    ("audio_hint", "Audio", None, 58, "Music", _MEDIA_ACTION, "review", _MEDIA_REASON, False,
     "File in a \"%4$s\" folder — probable audio asset.", ["audio"]),
    ("photo_hint", "Photography", None, 58, "Pictures", _MEDIA_ACTION, "review", _MEDIA_REASON, False,
     "File in a \"%4$s\" folder — probable photo asset.", ["photography"]),
    ("large_image", "Video", None, 78, None,
     "Large files occupy significant space; verify before removing.",
     "review", "Large files occupy significant space; verify before removing.", False,
     "Large %1$s file (%3$s MB) — consistent with a video export, disk image, or virtual machine.",
     ["large-file", "video"]),
    ("large", "Unknown", None, 45, None, _INSPECT,
     "review", "Large files without a clear category warrant manual inspection.", False,
     "Large file (%3$s MB, %6$s) — no recognisable category pattern. Manual review recommended.",
     ["large-file"]),
    ("unknown", "Unknown", None, 40, None, _INSPECT,
     "review", "File could not be automatically categorised.", False,
     "No category pattern recognised for \"%2$s\" (%6$s). Manual inspection recommended.",
     ["unknown"]),
]

# Texts of the document topics, completed from the topic table.
TOPIC_EXPLANATION = "Contains \"%4$s\" keyword in a %1$s file — likely a {category} document."
TOPIC_EXPLANATION_NO_EXT = "Contains \"%4$s\" keyword — likely a {category} document."
TOPIC_ACTION = "Keep and file under {destination} for record-keeping."
TOPIC_REASON = "{category} records should be retained per applicable record-keeping requirements."
