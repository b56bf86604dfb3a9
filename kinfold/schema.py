"""Row layouts and fixed vocabularies of the engine."""

from __future__ import annotations

# File categories and the extensions of each.
CATEGORIES = ("image", "document", "video", "archive", "code")
EXTENSIONS = {
    "image": ("jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff", "svg"),
    "document": ("txt", "doc", "docx", "odt", "pdf", "rtf", "srt", "vtt", "sub"),
    "video": ("mp4", "avi", "mkv", "mov", "wmv", "flv", "webm", "m4v"),
    "archive": ("zip", "tar", "gz", "bz2", "xz", "7z", "rar", "zst"),
    "code": ("py", "js", "ts", "exs", "html", "css", "jsx", "tsx", "vue", "rs", "go", "cpp", "c", "h"),
}

# Directory names whose whole subtree is skipped.
EXCLUDED_DIRS = ("node_modules", "__pycache__", ".git", ".svn", "venv", "env", ".venv", "dist", "build", ".cache", ".pytest_cache", ".mypy_cache")

# Screen sizes taken for desktops, either way round.
DESKTOP_SIZES = ((1920, 1080), (2560, 1440), (3840, 2160), (1366, 768), (1440, 900), (1680, 1050), (1920, 1200), (2560, 1600), (3440, 1440), (5120, 2880), (1280, 720), (1600, 900), (2560, 1080))

# Image classes in prototype order: label, display name, prompt.
IMAGE_CLASSES = (
    ("screenshot_desktop", "Desktop screenshot", "a screenshot of a desktop computer screen showing applications or a web browser"),
    ("screenshot_mobile", "Mobile screenshot", "a screenshot of a mobile phone or tablet user interface"),
    ("screen_recording_frame", "Screen recording frame", "a still frame from a screen recording or tutorial video capture"),
    ("photo_landscape", "Landscape photo", "a photograph of a natural landscape, scenery, mountains, ocean, forest, or travel vista"),
    ("photo_portrait", "Portrait / people photo", "a photograph focused on people, faces, portraits, selfies, or headshots"),
    ("photo_food", "Food photo", "a photograph of food, meals, drinks, or restaurant dishes"),
    ("photo_animal", "Animal photo", "a photograph of animals, pets, or wildlife"),
    ("photo_architecture", "Architecture photo", "a photograph of buildings, architecture, city streets, or real estate interiors"),
    ("photo_event", "Event / group photo", "a photograph of a group at an event, party, concert, wedding, or gathering"),
    ("photo_product", "Product / object photo", "a product photograph, macro shot, still life, or object on a plain background"),
    ("photo_general", "Photo (general)", "a general photograph not fitting other categories"),
    ("artwork", "Artwork", "a digital painting, illustration, or concept art in a non-anime style"),
    ("anime_manga", "Anime / manga art", "an anime or manga style illustration, fan art, or visual novel artwork"),
    ("pixel_art", "Pixel art", "pixel art, retro game sprites, or low-resolution stylized graphics"),
    ("comic", "Comic / strip", "a comic page, webcomic strip, or sequential panel artwork"),
    ("render_3d", "3D render", "a 3D computer render, CGI scene, or Blender output"),
    ("meme", "Meme", "an internet meme, reaction image, or humorous captioned image"),
    ("diagram", "Diagram", "a technical diagram, flowchart, schematic, mind map, or UML diagram"),
    ("infographic_chart", "Infographic / chart", "an infographic, data visualization, bar chart, line chart, or business graph"),
    ("scanned_document", "Scanned document", "a scanned document page, receipt, invoice, or photographed text document"),
    ("handwritten", "Handwritten / whiteboard", "handwritten notes on paper, a whiteboard photo, or sketch on paper"),
    ("ui_design", "UI design", "a user interface or UX mockup, wireframe, or design composition"),
    ("logo_icon", "Logo / icon", "a logo, app icon, favicon, or small symbolic graphic"),
    ("other", "Other", "an image that does not fit other categories"),
)

#: The six tables of the session store.
TABLES = {
    "scan_sessions": "id long, name string, created_at string, completed_at string, status string, file_types string, similarity_threshold double",
    "duplicate_groups": "id long, session_id long, file_type string, similarity_score double, hash_value string",
    "file_entries": "id long, group_id long, file_path string, file_size long, modified_time string, thumbnail_path string, file_metadata string, marked_for_deletion boolean",
    "signature_cache": "file_path string, file_size long, modified_at long, category string, signature string",
    "sorting_sessions": "id long, name string, created_at string, completed_at string, source_paths string, destination_path string, use_ml_categorization boolean, status string",
    "classification_cache": "file_path string, file_size long, modified_at long, sub_category string, confidence double, tier int",
}


def class_table(spark):
    """The 24 image classes as rows (idx, label, display_name, prompt)."""
    return spark.createDataFrame([(i, *c) for i, c in enumerate(IMAGE_CLASSES)], "idx int, label string, display_name string, prompt string")
