"""Normalise service error messages to ``code, description``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: message -> code and text; the order decides which of several prefixes wins ----------
ERROR_TEXTS = {
    "Access Key security groups not found": "ACCESSKEY_NOT_FOUND",
    "Alphabet was not found": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "Application has been authorized.": "27, Application has been authorized.",
    "Application has not been authorized.": "28, Application has not been authorized.",
    "Bulk re-protect is not supported": "51, Failed to send logs, connection refused !",
    "Card type must be invalid input": "44, The content of the input data is not valid.",
    "Card type must be valid input": "44, The content of the input data is not valid.",
    "Create operation failed.": "35, Create operation failed.",
    "Create operation was successful.": "34, Create operation was successful.",
    "Crypto operation failed": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "Data is too long to be protected/unprotected": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "Data is too long to be protected/unprotected.": "23, Data is too long to be protected/unprotected.",
    "Data is too short to be protected/unprotected.": "22, Data is too short to be protected/unprotected.",
    "Data protect operation failed.": "7, Data protection failed.",
    "Data protect operation was successful.": "6, Data protection was successful.",
    "Data reprotect operation was successful.": "50, Data protection was successful.",
    "Data unprotect operation failed.": "9, Data unprotect operation failed.",
    "Data unprotect operation was successful with use of an inactive keyid.": "11, Data unprotect operation was successful with use of an inactive keyid.",
    "Data unprotect operation was successful.": "8, Data unprotect operation was successful.",
    "Delete operation failed.": "33, Delete operation failed.",
    "Delete operation was successful.": "32, Delete operation was successful.",
    "Encoding must be provided": "12, Input is null or not within allowed limits.",
    "Encoding not supported": "UNSUPPORTED_ENCODING",
    "External IV is not supported in this version": "16, External IV is not supported in this version.",
    "FPE value identification position is bigger than the data": "12, Input is null or not within allowed limits.",
    "FPE value identification position is invalid": "44, The content of the input data is not valid.",
    "Failed to acquire policy mutex": "17, Failed to initialize the PEP - This is a fatal error",
    "Failed to allocate memory.": "20, Failed to allocate memory.",
    "Failed to calculate policy hash": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "Failed to check for first call": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "Failed to clear key context": "10, The user has the appropriate permissions to perform the requested operation. This is just a policy check and no data has been protected nor unprotected.",
    "Failed to convert input data": "21, Input or output buffer is too small.",
    "Failed to convert output data": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "Failed to convert padded input data": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "Failed to create Alphabet mutex": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "Failed to create event for flush thread": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "Failed to create key context": "10, The user has the appropriate permissions to perform the requested operation. This is just a policy check and no data has been protected nor unprotected.",
    "Failed to create log mutex": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "Failed to create policy Mutex": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "Failed to get binary alphabet": "21, Input or output buffer is too small.",
    "Failed to get session from cache": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "Failed to initialize crypto library": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "Failed to initialize the PEP - This is a fatal error": "17, Failed to initialize the PEP - This is a fatal error",
    "Failed to load Alphabet from Shmem": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "Failed to load FPE Properties from Shmem": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "Failed to load FPE prop - Internal error": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "Failed to load FPE prop - No such element": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "Failed to load data encryption key": "14, Failed to load data encryption key",
    "Failed to load data encryption key - Cache is full": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "Failed to load data encryption key - Internal error": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "Failed to load data encryption key - No such key": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "Failed to mask output data": "9, Data unprotect operation failed.",
    "Failed to reset policy": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "Failed to send logs, connection refused !": "51, Failed to send logs, connection refused !",
    "Failed to set authorization": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "Failed to set first call in cache": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "Failed to strip date": "21, Input or output buffer is too small.",
    "Failed to unstrip date": "44, The content of the input data is not valid.",
    "Hash operation failed": "26, Unsupported algorithm or unsupported action for the specific data element.",
    "IV can't be used with this token element": "26, Unsupported algorithm or unsupported action for the specific data element.",
    "IV is not supported with used encoding": "26, Unsupported algorithm or unsupported action for the specific data element.",
    "Input is null or not within allowed limits.": "12, Input is null or not within allowed limits.",
    "Input or output buffer is too small.": "21, Input or output buffer is too small.",
    "Integrity check failed": "21, Input or output buffer is too small.",
    "Integrity check failed.": "5, Integrity check failed.",
    "Internal error": "12, Input is null or not within allowed limits.",
    "Internal error occurring in a function call after the Pep Provider has been opened.": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "Invalid CT header format": "7, Data protection failed.",
    "Invalid UNICODE input data": "44, The content of the input data is not valid.",
    "Invalid date format": "44, The content of the input data is not valid.",
    "Invalid date input": "44, The content of the input data is not valid.",
    "Invalid email address": "44, The content of the input data is not valid.",
    "Invalid email address, domain length > 254": "23, Data is too long to be protected/unprotected.",
    "Invalid email address, total length > 256": "23, Data is too long to be protected/unprotected.",
    "Invalid email address, wrong domain length": "23, Data is too long to be protected/unprotected.",
    "Invalid email address, wrong local length": "44, The content of the input data is not valid.",
    "Invalid input data": "44, The content of the input data is not valid.",
    "Invalid input data for FPE creditcard": "44, The content of the input data is not valid.",
    "Invalid input for the creditcard FPE type": "44, The content of the input data is not valid.",
    "Invalid input for the creditcard token type": "44, The content of the input data is not valid.",
    "Invalid input for the decimal token type": "44, The content of the input data is not valid.",
    "Invalid input parameter": "44, The content of the input data is not valid.",
    "Invalid license or time is before licensestart.": "42, Invalid license or time is before licensestart.",
    "Invalid parameter": "21, Input or output buffer is too small.",
    "Invalid shared memory contents": "26, Unsupported algorithm or unsupported action for the specific data element.",
    "Invalid time format": "44, The content of the input data is not valid.",
    "Invalid tokenproc": "12, Input is null or not within allowed limits.",
    "Invalid use of Hmac Data Element": "26, Unsupported algorithm or unsupported action for the specific data element.",
    "Luhn value must be invalid": "44, The content of the input data is not valid.",
    "Luhn value must be valid": "44, The content of the input data is not valid.",
    "Malloc for the JSON type failed.": "30, Malloc for the JSON type failed.",
    "Manage protection operation failed.": "37, Manage protection operation failed.",
    "Manage protection operation was successful.": "36, Manage protection operation was successful.",
    "No such token element": "UNSUPPORTED_ENCODING",
    "No token elements available": "2, The data element could not be found in the policy.",
    "No valid license or current date is beyond the license expiration date.": "40, No valid license or current date is beyond the license expiration date.",
    "Out buffer size is too small": "12, Input is null or not within allowed limits.",
    "Output buffer is to small": "23, Data is too long to be protected/unprotected.",
    "Output buffer is too small": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "Output encoding is not supported for Masking": "12, Input is null or not within allowed limits.",
    "Permission denied": "33, Delete operation failed.",
    "Pointer to the policy shared memory is null": "12, Input is null or not within allowed limits.",
    "Policy not available": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "Protected value can't be returned for this type of algorithm": "10, The user has the appropriate permissions to perform the requested operation. This is just a policy check and no data has been protected nor unprotected.",
    "Provider not initialized": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "Rule Set not found": "RULESET_NOT_FOUND",
    "The IV value is too long": "12, Input is null or not within allowed limits.",
    "The IV value is too short": "12, Input is null or not within allowed limits.",
    "The JSON type is not serializable.": "29, The JSON type is not serializable.",
    "The User has appropriate permissions to perform the requested operation but no data has been protected/unprotected.": "10, The user has the appropriate permissions to perform the requested operation. This is just a policy check and no data has been protected nor unprotected.",
    "The content of the input data is not valid.": "44, The content of the input data is not valid.",
    "The data element could not be found in the policy in shared memory.": "2, The data element could not be found in the policy.",
    "The data element is not using key id": "0, ",
    "The input is too long": "23, Data is too long to be protected/unprotected.",
    "The input is too short": "22, Data is too short to be protected/unprotected.",
    "The policy in shared memory is empty.": "31, Policy not available",
    "The policy in shared memory is locked. This can be caused by a disk full alert.": "39, The policy in memory is locked. This can be caused by a disk full alert.",
    "The requested action is not supported for tokenization": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "The tokenized email became too long": "21, Input or output buffer is too small.",
    "The use of the protection method is restricted by license.": "41, The use of the protection method is restricted by license.",
    "The user does not have the appropriate permissions to perform the requested operation.": "3, The user does not have the appropriate permissions to perform the requested operation.",
    "The username could not be found in the policy in shared memory.": "1, The username could not be found in the policy.",
    "Token value identification position is bigger than the data": "12, Input is null or not within allowed limits.",
    "Token value identification position is invalid": "44, The content of the input data is not valid.",
    "Tokenization is disabled": "26, Unsupported algorithm or unsupported action for the specific data element.",
    "Tweak generation is failed": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "Tweak input is too long": "15, Tweak input is too long.",
    "Tweak is null.": "4, Tweak is null.",
    "Unsupported algorithm or unsupported action for the specific data element.": "26, Unsupported algorithm or unsupported action for the specific data element.",
    "Unsupported input encoding for the specific data element.": "UNSUPPORTED_ENCODING",
    "Unsupported operation for that datatype": "26, Unsupported algorithm or unsupported action for the specific data element.",
    "Unsupported tokenizer type.": "26, Unsupported algorithm or unsupported action for the specific data element.",
    "Unsupported tweak action for the specified fpe dataelement": "19, Unsupported tweak action for the specified fpe dataelement",
    "Unsupported version": "26, Unsupported algorithm or unsupported action for the specific data element.",
    "Used for z/OS Query Default Data element when policy name is not found": "46, Used for z/OS Query Default Data element when policy name is not found.",
    "Username too long.": "9, Data unprotect operation failed.",
    "iconv failed - 8859-15 to system": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "iconv failed - system to 8859-15": "13, Internal error occurring in a function call after the Core Provider has been opened.",
    "User not authorized. Refer to audit log for details.": "3, The user does not have the appropriate permissions to perform the requested operation.",
    "Data element not found. Refer to audit log for details.": "2, The data element could not be found in the policy.",
    "Integer input error. Only digits allowed": "44, The content of the input data is not valid.",
    "Integer input out of range. Valid values are -2147483648 to 2147483647": "44, The content of the input data is not valid.",
    "Invalid data length": "44, The content of the input data is not valid.",
    "Invalid base64-encoded data, character out of range": "26, Unsupported algorithm or unsupported action for the specific data element.",
}
# "<anything> failed. <place>:<message>", then "<anything> failed. <message>", then the whole text
MESSAGE_PATTERNS = (r"(?i)^.*\s+failed\.\s+[^:]+:(.+)$", r"(?i)^.*\s+failed\.\s+(.+)$", r"^(.+)$")
# ------------------------------------------------------------------------------------------------------


def core_message(message: Column | str) -> Column:
    """The message without the operation and place in front of it."""
    message = F.col(message) if isinstance(message, str) else message
    text = _stripped(message)
    found = [F.nullif(_stripped(F.regexp_extract(text, p, 1)), F.lit("")) for p in MESSAGE_PATTERNS]
    return F.coalesce(*found, message)


def normalise(message: Column | str) -> Column:
    """Exact lookup of the core message; else the first entry of which one is a prefix of the other; else
    the message as it came.  Row-local: the table is a literal, so nothing is joined."""
    message = F.col(message) if isinstance(message, str) else message
    known = F.create_map(*[F.lit(x) for pair in ERROR_TEXTS.items() for x in pair])
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("text")) for k, v in ERROR_TEXTS.items()])

    def looked_up(core: Column) -> Column:
        close = F.filter(entries, lambda e: F.startswith(core, e["key"]) | F.startswith(e["key"], core))
        return F.coalesce(F.try_element_at(known, core), F.get(close, F.lit(0))["text"])

    # a one-element array binds the core message to a name, so its patterns run once and not per entry
    found = F.get(F.transform(F.array(core_message(message)), looked_up), F.lit(0))
    return F.when(message == "", message).otherwise(F.coalesce(found, message))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")
