"""Fixed values of the catalogue's data model."""

#: File type by extension: fixed values.
EXTENSIONS = {
    "raw": [".cr2", ".cr3", ".nef", ".arw", ".orf", ".rw2", ".dng"],
    "jpeg": [".jpg", ".jpeg", ".jpe", ".gif", ".png"],
    "video": [".mp4", ".mov", ".m4v", ".avi", ".mts", ".m2ts", ".3gp", ".mpg", ".mpeg", ".tod"],
    "psd": [".psd", ".psb", ".pspimage"],
    "tiff": [".tif", ".tiff"],
    "sidecar": [".xmp", ".vrd", ".dop", ".dpp", ".pp3"],
}
#: Extensions that the video diagnostic takes besides the video ones: fixed values.
MORE_VIDEO = [".mkv", ".flv", ".wmv", ".webm"]
#: Types that have capture metadata.
MEDIA_TYPES = ["raw", "jpeg", "video", "psd", "tiff"]
#: Names that cameras give, of the lower-case stem: fixed values.
CAMERA_NAMES = [r"^img_\d+$", r"^dsc_\d+$", r"^dscf\d+$", r"^pxl_\d+$", r"^sam_\d+$", r"^_dsc\d+$", r"^cimg\d+$"]
#: Tags with a capture date, in order of trust: fixed values.
EXIF_DATE_TAGS = ["EXIF DateTimeOriginal", "EXIF DateTimeDigitized", "Image DateTime"]
#: Bytes from which a file is fingerprinted sparsely, and bytes of each block of a sparse fingerprint: fixed values.
SPARSE_FROM = 5 * 1024 * 1024
SPARSE_BLOCK = 4096
#: Confidence of a link by the way it was found: fixed values.
CONFIDENCE = {"filename_time": 100, "time_camera": 90, "phash": 70, "stem": 100, "smart_object": 95}
#: Issue of a log line and its pattern, the first match counts: fixed values.
LOG_ISSUES = {
    "exif_read_failed": r"EXIF read failed for (.+?):",
    "no_exif_tags": r"No EXIF tags found for (.+)",
    "no_exif_date": r"No EXIF date found for (.+?) \(tags tried:",
    "using_filesystem_time_image": r"Using filesystem mtime as capture_datetime for (.+)",
    "mediainfo_failed": r"MediaInfo\.parse failed for (.+?):",
    "no_video_metadata": r"No usable video metadata found for (.+?); will fall back to filesystem time\.",
    "using_filesystem_time_video": r"Using filesystem mtime as capture_datetime for video (.+)",
    "phash_failed": r"pHash computation failed for (.+?):",
    "image_size_failed": r"Failed to get image size for (.+?):",
}
