from fidelscope.operators.model import TextModel


def small_model():
    return TextModel(
        (0, 1, 2), ("ሰላም", "ስድብ", "ጥላቻ"), (1.0, 1.5, 2.0),
        ((1.0, -1.0, -1.0), (-1.0, 0.5, 1.0), (-1.0, 1.0, 0.5)), (0.25, 0.25, 0.1),
    )
