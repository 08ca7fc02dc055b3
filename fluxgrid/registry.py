"""Operators by name: where each operator of the data-flow engine is in this library."""

from __future__ import annotations

from importlib import import_module

#: Operator -> module:function.  Operators that only pass values on are the identity.
NUMBERS = {
    # arithmetic
    "CheckNumbersEquality": "operators.arithmetic:check_equal",
    "CheckNumbersInRange": "operators.arithmetic:check_in_range",
    "LinearCombinationOfTwoNumbers": "operators.arithmetic:linear",
    "MaxNumbers": "operators.arithmetic:extreme",
    "MinNumbers": "operators.arithmetic:extreme",
    "NumbersAbs": "operators.arithmetic:absolute",
    "NumbersCartesianToPolar": "operators.arithmetic:polar",
    "NumbersDifference": "operators.arithmetic:difference",
    "NumbersEquality": "operators.arithmetic:equality",
    "NumbersExponent": "operators.arithmetic:exponent",
    "NumbersInRange": "operators.arithmetic:in_range",
    "NumbersInSeveralRanges": "operators.arithmetic:in_several_ranges",
    "NumbersLogarithm": "operators.arithmetic:logarithm",
    "NumbersNegate": "operators.arithmetic:negated",
    "NumbersPolarToCartesian": "operators.arithmetic:cartesian",
    "NumbersProductOfTwoPowers": "operators.arithmetic:product_of_powers",
    "NumbersSumOfPowers": "operators.arithmetic:sum_of_powers",
    "NumbersTrigonometry": "operators.arithmetic:trigonometry",
    "ReplaceAllNaN": "operators.arithmetic:replace_nan",
    "ScaleAndExtractColumns": "operators.arithmetic:scaled_columns",
    # conversion and creation
    "CastNumbers": "model:Numbers.cast",
    "CopyNumbers": "registry:identity",
    "ExtractNumbers": "operators.shapes:extract",
    "ExtractNumbersColumns": "model:Numbers.slice",
    "ExtractNumbersColumnsByNames": "operators.shapes:columns_by_name",
    "ExtractNumbersInRange": "operators.shapes:keep_in_range",
    "JsonToColorPalette": "operators.tables:palette",
    "JsonToIndexValueTable": "operators.tables:index_table",
    "JsonToNumbers": "operators.shapes:json_numbers",
    "MergeNumbers": "operators.shapes:merge_rows",
    "MergeNumbersColumns": "operators.shapes:merge_columns",
    "CombineNamedNumbersColumns": "operators.tables:named_columns",
    "NumbersToJson": "operators.shapes:numbers_json",
    "RectangularAreaToScalars": "operators.tables:area_scalars",
    "ReplaceNumbers": "operators.shapes:replace_rows",
    "ReplaceNumbersColumns": "operators.shapes:replace_columns",
    "RoundNumbers": "operators.shapes:rounded",
    "SplitNumbersColumns": "operators.shapes:split_columns",
    "FillNumbersColumnsByArithmeticProgression": "operators.shapes:fill_progression",
    "CreateArithmeticProgression": "operators.shapes:progression",
    "CreateIntegerRectangle": "operators.shapes:rectangle",
    "CreateNumbersFromString": "operators.shapes:from_text",
    "CreateNumbersFromValues": "model:literal_array",
    "CreateRandomNumbers": "operators.shapes:random_numbers",
    "CreateRectangularArea": "operators.shapes:rectangle",
    # files of numbers, lookups, statistics
    "MultiReadRawNumbers": "sources.files:read_raw",
    "PrintNumbers": "operators.tables:text_lines",
    "JoinNumbersToScalar": "operators.tables:text_lines",
    "ReadCSVNumbers": "sources.files:read_csv",
    "ReadRawNumbers": "sources.files:read_raw",
    "WriteCSVNumbers": "sources.files:write_csv",
    "WriteRawNumbers": "sources.files:write_raw",
    "ContrastAndClassifyNumbers": "operators.statistics:contrast",
    "GetNumber": "operators.lookups:element",
    "SetNumber": "operators.lookups:with_element",
    "InvertTable": "operators.lookups:invert_table",
    "NearestClusterCenters": "operators.lookups:nearest_centres",
    "NumbersInfo": "operators.statistics:info",
    "NumbersLength": "operators.tables:length",
    "SetArrayLength": "operators.lookups:set_length",
    "SortNumbers": "operators.lookups:sort",
    "TableTranslateNumbers": "operators.lookups:translate",
    "NumbersColumnsStatistics": "operators.statistics:column_statistics",
    "NumbersStatistics": "operators.statistics:all_statistics",
}

FLOW = {
    "CancelOrCopy": "operators.flow:cancel_or_copy",
    "CopySeveral": "registry:identity",
    "ThrowException": "operators.flow:throw_if",
    **{f"IfScalarThen{k}": "operators.flow:choose" for k in ("Matrix", "Numbers", "Scalar")},
    **{f"Is{k}Existing": "operators.flow:exists" for k in ("Matrix", "Numbers", "Scalar")},
    **{f"Redirect{k}": "operators.flow:redirect" for k in ("Matrix", "Numbers", "Scalar")},
    **{f"Switch{k}": "operators.flow:switch" for k in ("Matrix", "Numbers", "Scalar")},
    "IterationCount": "operators.flow:Loop",
    "RepeatWhile": "operators.flow:Loop",
    **{f"Copy{k}IfRequested": "operators.constants:copy_if_requested" for k in ("", "Matrices", "Numbers", "Scalars")},
}

SCALARS = {
    **{f"Create{k.title()}": f"operators.constants:create_{k}" for k in ("boolean", "double", "integer", "json", "scalar")},
    "CopyJson": "operators.constants:copy_json",
    "PrintScalar": "operators.constants:print_scalar",
    "WriteScalar": "operators.constants:write_scalar",
    "AbsNumber": "functions.scalars:absolute",
    "CheckNumberInRange": "functions.scalars:in_range",
    "CheckScalarsEquality": "functions.scalars:same",
    "CompareTwoNumbers": "functions.scalars:compare",
    "LinearCombinationOfTwoScalars": "functions.scalars:linear",
    "MaxNumber": "functions.scalars:extreme",
    "MinNumber": "functions.scalars:extreme",
    "ProductOfTwoPowers": "functions.scalars:product_of_powers",
    "RoundScalar": "functions.scalars:rounded",
    "TruncateToRange": "functions.scalars:truncated",
    "NumericRangeToConstant": "functions.scalars:range_to_constant",
    "SplitScalarToNumbers": "functions.scalars:numbers",
    "CopyScalar": "registry:identity",
    "ReadJson": "sources.files:read_json",
    "ReadScalar": "sources.files:read_scalar",
    "ReadNextScalar": "sources.files:scalars_in_folder",
    "GetAllJsonKeys": "functions.scalars:json_keys",
    "GetJsonValue": "functions.scalars:json_value",
    "SetJsonValue": "functions.scalars:json_with",
    "AndBoolean": "functions.scalars:and_all",
    "OrBoolean": "functions.scalars:or_all",
    **{f"{k}Boolean": "functions.scalars:logical" for k in ("AndNot", "Copy", "Equivalence", "Not", "OrNot", "Xor")},
    "ScalarLength": "functions.scalars:length",
    "ConcatenateScalars": "functions.scalars:concatenated",
    "ReplaceScalar": "functions.scalars:inserted",
    "SplitScalar": "functions.scalars:split",
}

MATRICES = {
    "CheckMatrixEquality": "operators.matrices:equality",
    "MatrixAbs": "operators.matrices:absolute",
    "MatrixAngleDifference": "operators.vectors:angle_difference",
    "MatrixArctangent": "operators.matrices:arctangent",
    "MatrixCutToRange": "operators.matrices:cut",
    "MatrixDifference": "operators.matrices:difference",
    "MatrixDifferenceFromPair": "operators.vectors:difference_from_pair",
    "MatrixDoubleAngleOf2DVector": "operators.vectors:double_angle",
    "MatrixInvert": "operators.matrices:inverted",
    "MatrixLinearCombination": "operators.matrices:linear",
    "MatrixNormalize2DVector": "operators.matrices:normalised_vector",
    "MatrixProductOfTwoPowers": "operators.matrices:product_of_powers",
    "MatrixSumOfPowers": "operators.matrices:sum_of_powers",
    "MaxMatrix": "operators.matrices:extreme",
    "MinMatrix": "operators.matrices:extreme",
    "ApplyMask": "operators.matrices:masked",
    "ChangeNumberOfChannels": "operators.matrices:with_channels",
    "ChangePrecision": "operators.matrices:precision",
    "RawCastPrecision": "operators.matrices:precision",
    "ExtractChannelsGroup": "operators.matrices:channel_group",
    "ExtractLayerWithDecreasingNumberOfDimensions": "operators.matrices:layer",
    "FindValue": "operators.matrices:find_value",
    "Intensity": "operators.matrices:intensity",
    "InterpolateLayersWithIncreasingNumberOfDimensions": "operators.matrices:interpolated",
    "MergeBinaryMasks": "operators.matrices:merge_masks",
    "MergeChannelsGroups": "operators.matrices:merge_channels",
    "MergeColorChannels": "operators.vectors:merge_colours",
    "MergeLastTwoDimensions": "operators.matrices:flattened",
    "NonZero": "operators.matrices:non_zero",
    "SplitChannels": "operators.matrices:split_channels",
    "SplitColorChannels": "operators.vectors:split_colours",
    "CopyMatrix": "registry:identity",
    "FillMatrix": "operators.matrices:filled",
    "CreateBilinearFunction": "operators.matrices:bilinear",
    "CreateConstantMatrix": "model:grid",
    "Resize": "operators.matrices:resized",
    "Shift": "operators.matrices:shifted",
    "SubMatrix": "operators.matrices:cropped",
    "Contrast": "operators.vectors:contrast",
    "MatrixDifferenceInfo": "operators.vectors:difference_info",
    "MatrixInfo": "operators.matrices:info",
    "Selector": "operators.matrices:selected",
    "ImageStatistics": "operators.vectors:image_statistics",
    "DrawArrow": "operators.drawing:arrow",
    "DrawEllipse": "operators.drawing:ellipse",
    "DrawImage": "operators.drawing:overlay",
    "DrawLine": "operators.drawing:line",
    "DrawRectangle": "operators.drawing:rectangle",
    "DrawStraight": "operators.drawing:straight",
    "ReadImage": "sources.folders:read_image",
    "WriteImage": "sources.folders:write_png",
    "PrintSubMatrix": "operators.constants:print_sub_matrix",
    "ReadNextImage": "sources.folders:next_image",
    "SupportedImageFormats": "sources.folders:image_formats",
    "ReadMatrixFolder": "sources.folders:read_matrix",
    "WriteMatrixFolder": "sources.folders:write_matrix",
}

SYSTEM = {
    "ChangeFileExtension": "sources.folders:changed_extension",
    "CheckFileExistence": "sources.folders:existence",
    "CopyMoveFiles": "sources.folders:copy_or_move",
    "CreateFolder": "sources.folders:create_folder",
    "CreatePath": "sources.folders:resolve",
    "ResolvePath": "sources.folders:resolve",
    "FindNextFile": "sources.folders:FileIterator",
    "ListOfFiles": "sources.folders:list_of_files",
    "RemoveFiles": "sources.folders:remove_files",
    "RemoveFolder": "sources.folders:remove_folder",
    "UseChain": "plans.chains:Chain.read",
    "InterpretChain": "plans.chains:Chain.run",
    "UseMultiChain": "plans.chains:MultiChain",
    "InterpretMultiChain": "plans.chains:MultiChain.run",
    "ElementwiseFormula": "plans.formulas:elementwise",
    "BlockFormulaForSeveralNumbers": "plans.formulas:by_row",
    "UseMapping": "plans.settings:mapping_keys",
    "MappingExecutor": "plans.settings:mapping_record",
    "UseSettings": "plans.settings:Settings.read",
    "CombineSettings": "plans.settings:Settings.combine",
    "SplitSettings": "plans.settings:Settings.split",
    "GetNamesOfSettings": "plans.settings:Settings.names",
    "AddSubSettings": "plans.settings:with_sub",
    "GetSubSettings": "plans.settings:sub",
    **{f"{a}{b}Settings": f"plans.settings:Settings.{a.lower()}" for a in ("Combine", "Split") for b in ("Chain", "MultiChain")},
    "GetNamesOfChainSettings": "plans.settings:Settings.names",
    **{f"Use{k}Settings": "plans.settings:Settings.read" for k in ("Chain", "MultiChain")},
    **{f"ReloadInstalled{k}": "plans.chains:Registry" for k in ("Chains", "ChainSettings")},
    "GetSettingsTree": "plans.system:settings_tree",
    "GetExecutorSpecification": "plans.system:specification",
    "SystemInformation": "plans.system:system_information",
    **{f"{k}PlatformInformation": "plans.system:platform_information" for k in ("Any", "Common")},
    "CheckClassExistence": "plans.system:class_exists",
    "CreateLogLevel": "plans.system:log_level",
    "ShowStatus": "plans.system:show_status",
    "Gc": "plans.system:collect_garbage",
    "CommonJS": "plans.scripts:scalar_formula",
    "RepeatJS": "plans.scripts:repeat",
    "BlockJSModifyingNamedNumbers": "plans.scripts:modify_named",
    "BlockJSModifyingSeveralNumbers": "plans.scripts:modify_several",
    **{n: "plans.scripts:call" for n in ("CallPythonFunction", "InterpretPython", "CallPythonExternalFunction")},
    **{n: "plans.scripts:use" for n in ("UseJS", "CallJSFunction", "CallJSExternalFunction", "InterpretJS")},
}

EXAMPLES = {
    "ExampleSNumbers": "operators.examples:doubled",
    "ExampleSMatCreate": "operators.examples:created",
    "ExampleSMatIncreaseBytes": "operators.examples:increased",
    "ExampleSMatFunction": "operators.examples:function_of_place",
    "ExampleResultIsSometimesNull": "operators.examples:sometimes_missing",
    "ExampleSScalar": "registry:identity",
}

OPERATORS = {**EXAMPLES, **NUMBERS, **FLOW, **SCALARS, **MATRICES, **SYSTEM}


def identity(x):
    """Pass a value on."""
    return x


def find(name: str):
    """The function of an operator."""
    module, _, path = OPERATORS[name].partition(":")
    out = import_module(f"fluxgrid.{module}")
    for part in path.split("."):
        out = getattr(out, part)
    return out
